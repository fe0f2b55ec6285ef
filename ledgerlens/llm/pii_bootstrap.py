"""Personal data: fixed patterns as seeds, bootstrapped contexts beyond them.

The fixed patterns (e-mail, IP, card, phone) find the base spans. The words
around these seeds, and around every other identifier-like token (one that
holds a digit or ``@``), become lexical patterns; Spark scores the bipartite
graph of patterns and instances in a few rounds (a pattern's confidence is the
share of its instances that are believed, an instance's is the noisy-or of its
patterns), and patterns of high confidence mark identifiers that no fixed
pattern knows. Base spans always stay.

Accepted patterns are a table of any length. Up to ``BROADCAST_PATTERNS`` of
them (counted first) travel to the tasks; more are joined to the contexts of
the candidates, and the hits go back to their texts.

Defined cases: NULL text is empty and has no spans; rows are judged one by one
(repeated rows, equal or NULL ids); ties between spans go by start, then kind;
an empty table gives an empty result; other columns are ignored. Very long texts
are searched whole, words of a context and identifiers of any length are told
apart (long ones by their SHA-256), and no distance ends a context.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._shared import Scratch, fresh

# The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits does, so the lookbehind changes nothing but the time on long runs
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?()[]{}<>\"'|"
_GROUP = re.compile(r"\+?[0-9][0-9().+/-]*")
_BETWEEN = (" ", ") ", " (", ") (")

# so many patterns are sent to every task (some 200 bytes each); more are joined, with each pattern on SALTS tasks
BROADCAST_PATTERNS = 10_000
SALTS = 16

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; found from each ``@`` so that long runs of
    letters cost linear time."""
    last = 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            yield start, m.end()
            last = m.end()
        at = t.find("@", at + 1)


def base_spans(text: str | None) -> list[Span]:
    t = text or ""
    if not _ANY.search(t):
        return []
    out: list[Span] = [(a, 0, b) for a, b in _emails(t)]
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(t):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class _Contexts:
    """Patterns of the places of one text, in time that follows its length:
    words are found once, and a word that is glued to identifiers (``a@b.c,d@e.f``)
    reaches to the nearest of them only."""

    def __init__(self, t: str, places: list[tuple[int, int]]):
        self.t = t
        found = [m.span() for m in _TOKEN.finditer(t)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]
        self.place_starts, self.place_ends = sorted(a for a, _ in places), sorted(b for _, b in places)
        self.whole: dict[int, str] = {}

    def _word(self, k: int) -> str:
        if k not in self.whole:
            self.whole[k] = _norm(self.t[self.starts[k] : self.ends[k]])
        return self.whole[k]

    def of(self, start: int, end: int) -> list[str]:
        """The word before, the two before, the word on either side."""
        k = bisect_left(self.starts, start)
        left = [self._word(i) for i in range(max(0, k - 2), k)]
        if left and self.ends[k - 1] > start:
            i = bisect_right(self.place_ends, start)
            left[-1] = _norm(self.t[max(self.starts[k - 1], self.place_ends[i - 1] if i else 0) : start])
        if not left:
            return []
        out = [f"{left[-1]} _"]
        if len(left) == 2:
            out.append(f"{left[0]} {left[1]} _")
        k = bisect_right(self.ends, end)
        if k < len(self.ends):
            right = self._word(k) if self.starts[k] >= end else None
            if right is None:
                i = bisect_left(self.place_starts, end)
                right = _norm(self.t[end : min(self.ends[k], self.place_starts[i] if i < len(self.place_starts) else self.ends[k])])
            out.append(f"{left[-1]} _ {right}")
        return out


def _norm(w: str) -> str:
    return _named(re.sub(r"[0-9]+", "0", w.lower()), 40)


def _named(x: str, most: int) -> str:
    """``x``, or where it is longer than ``most`` its digest: short, and no other string's."""
    return x if len(x) <= most else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def _others(t: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Tokens that hold a digit or ``@``, outside all spans; groups of digits
    with one space between them (``020 7946 0958``) are one candidate. The
    patterns decide, not the number of digits."""
    start, end = -1, -1
    at, ends = 0, sorted((s, e) for s, _, e in spans)
    for m in _TOKEN.finditer(t):
        if not _ANY.search(m.group()):
            continue
        a, b = m.span()
        while a < b and t[a] in _EDGES:
            a += 1
        while b > a and t[b - 1] in _EDGES:
            b -= 1
        while at < len(ends) and ends[at][1] <= a:
            at += 1
        if a == b or any(s < b and a < e for s, e in _from(ends, at, b)):
            continue
        group = _GROUP.fullmatch(t, a, b) is not None
        if group and start >= 0 and t[end:a] in _BETWEEN:
            # a bracket that closes after the first group belongs to the number
            if t[end] == ")" and start and t[start - 1] == "(" and ")" not in t[start:end]:
                start -= 1
            end = b
            continue
        if start >= 0:
            yield start, end
            start = -1
        if group:
            start, end = a, b
        else:
            yield a, b
    if start >= 0:
        yield start, end


def _from(spans: list[tuple[int, int]], at: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans from place ``at`` on that start before ``end``."""
    while at < len(spans) and spans[at][0] < end:
        yield spans[at]
        at += 1


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])
    for b in batches:
        seen: Counter = Counter()
        for x in b.column(0):
            t = x.as_py() or ""
            if not _ANY.search(t):
                continue
            spans = base_spans(t)
            others = list(_others(t, spans))
            contexts = _Contexts(t, [(a, e) for a, _, e in spans] + others)
            for a, kind, e in spans + [(a, -1, e) for a, e in others]:
                for p in contexts.of(a, e):
                    seen[p, _named(t[a:e], 200), kind] += 1
        rows = [{"pattern": p, "instance": i, "kind": k, "n": n} for (p, i, k), n in seen.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def pattern_table(
    docs: DataFrame, scratch: Scratch, text: str = "text", rounds: int = 3, min_confidence: float = 0.8, min_instances: int = 5,
) -> DataFrame:
    """Every accepted pattern once, with its surest kind. Mentions of the whole
    corpus are counted map-side and summed; scores travel along the edges of
    the (pattern, instance) graph as joins of aggregates."""
    edges = docs.select(F.col(text).alias("t")).mapInArrow(_mentions, "pattern string, instance string, kind int, n long")
    edges = edges.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n"))
    # patterns with too few different instances can never be accepted
    wide = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("width")).filter(F.col("width") >= min_instances)
    edges = scratch.write(edges.join(wide, "pattern", "left_semi"))
    believed = edges.filter("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    accepted = None
    for _ in range(rounds):
        support = edges.select("pattern", "instance").distinct()
        joined = support.join(believed, "instance", "left")
        per_kind = joined.filter("score IS NOT NULL").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("hits"))
        size = support.groupBy("pattern").agg(F.count("*").alias("size"))
        accepted = per_kind.join(size, "pattern").withColumn("confidence", F.col("mass") / (F.col("size") + 1))
        accepted = scratch.write(accepted.filter((F.col("confidence") >= min_confidence) & (F.col("hits") >= min_instances)).select("pattern", "kind", "confidence"))
        # an unseen instance is believed by the noisy-or of its patterns
        unseen = edges.filter("kind < 0").select("pattern", "instance").distinct()
        new = unseen.join(accepted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        seeds = edges.filter("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
        believed = scratch.write(seeds.union(new))
    return scratch.write(accepted.groupBy("pattern").agg(F.min_by("kind", F.struct(-F.col("confidence"), F.col("kind"))).alias("kind")))


def learn_patterns(docs: DataFrame, scratch: Scratch, text: str = "text", **limits) -> dict[str, int]:
    """``pattern_table`` as a dictionary on the driver, for small corpora."""
    return _collected(pattern_table(docs, scratch, text, **limits))


def _collected(patterns: DataFrame) -> dict[str, int]:
    return {r["pattern"]: r["kind"] for r in patterns.collect()}


def extra_spans(t: str, spans: list[Span], patterns: dict[str, int]) -> list[Span]:
    out = []
    if patterns:
        others = list(_others(t, spans))
        contexts = _Contexts(t, [(a, e) for a, _, e in spans] + others) if others else None
        for a, b in others:
            kinds = [patterns[p] for p in contexts.of(a, b) if p in patterns]
            if kinds:
                out.append((a, min(kinds), b))
    return out


def _join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_SPANS = "array<struct<a:bigint,k:int,b:bigint>>"


def _hits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """h_key (SHA-256 of a text ``t``) and its extra spans, by a join of the
    contexts of its candidates with the patterns."""
    schema = pa.schema([("key", pa.string()), ("salt", pa.int32()), ("pattern", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for x in b.column(0):
                t = x.as_py() or ""
                if not _ANY.search(t):
                    continue
                digest = hashlib.sha256(t.encode())
                base = base_spans(t)
                others = list(_others(t, base))
                contexts = _Contexts(t, [(a, e) for a, _, e in base] + others)
                for a, e in others:
                    for p in contexts.of(a, e):
                        for c, v in zip(cols, (digest.hexdigest(), (digest.digest()[0] + a) % SALTS, p, a, e), strict=True):
                            c.append(v)
            yield from pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema).to_batches(max_chunksize=20_000)

    found = texts.select("t").mapInArrow(run, "key string, salt int, pattern string, a long, b long")
    # a hot pattern meets its candidates on SALTS tasks
    salted = patterns.select(F.col("pattern").alias("p"), F.col("kind").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    found = found.join(salted, (F.col("pattern") == F.col("p")) & (F.col("salt") == F.col("s")))
    found = found.groupBy("key", "a", "b").agg(F.min("k").alias("k"))
    return found.groupBy(F.col("key").alias("h_key")).agg(F.collect_list(F.struct("a", "k", "b")).alias("h_spans"))


def find_spans(docs: DataFrame, patterns: dict[str, int] | DataFrame, text: str = "text", most: int = BROADCAST_PATTERNS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans. A
    table of more than ``most`` patterns is joined instead of sent to the tasks."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    if isinstance(patterns, dict):
        return _find_here(d, patterns).drop("key")
    if patterns.count() <= most:
        return _find_here(d, _collected(patterns)).drop("key")
    base = _find_here(d, {}, keyed=True)
    out = base.join(_hits(d, patterns), F.col("key") == F.col("h_key"), "left")
    one = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    kind = lambda x: (F.array_position(F.array(*[F.lit(n) for n in KINDS]), x) - 1).cast("int")
    spans = F.transform(one, lambda x: F.struct(x[1].cast("bigint").alias("a"), kind(x[0]).alias("k"), x[2].cast("bigint").alias("b")))
    spans = F.array_sort(F.concat(spans, F.coalesce("h_spans", F.array().cast(_SPANS))))
    names = F.array(*[F.lit(n) for n in KINDS])
    joined = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"].cast("string"), x["b"].cast("string"))), ",")
    return out.withColumn("spans", joined).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")


def _find_here(d: DataFrame, patterns: dict[str, int], keyed: bool = False) -> DataFrame:
    """Spans with patterns that every task holds; ``keyed``: with the text's SHA-256."""
    schema = pa.schema(
        [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("key", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, joined, keys = [], [], []
            for x in b.column(1):
                t = x.as_py() or ""
                base = base_spans(t)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base) if base else 0)
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest() if base else none)
                joined.append(_join(base + extra_spans(t, base, patterns)) if base or patterns and _ANY.search(t) else "")
                keys.append(hashlib.sha256(t.encode()).hexdigest() if keyed else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(keys, pa.string())],
                schema=schema,
            )

    return d.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, key string")


def mask(docs: DataFrame, patterns: dict[str, int] | DataFrame, text: str = "text", most: int = BROADCAST_PATTERNS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, ``[email]``;
    of overlapping spans the first is named and the rest of them goes with it."""
    if not isinstance(patterns, dict) and patterns.count() > most:
        return _mask_joined(docs, patterns, text)
    known = patterns if isinstance(patterns, dict) else _collected(patterns)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([_masked(x.as_py(), known) for x in b], pa.string())

    return docs.withColumn(text, run(F.col(text)))


def _mask_joined(docs: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    hits = _hits(docs.select(F.col(text).alias("t")), patterns)
    key, more = fresh(docs, "h_key"), fresh(docs, "h_spans")
    hits = hits.select(F.col("h_key").alias(key), F.col("h_spans").alias(more))
    out = docs.join(hits, F.sha2(F.encode(F.col(text), "UTF-8"), 256) == F.col(key), "left")

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, extra in batches:
            spans = ([(s["a"], s["k"], s["b"]) for s in x.as_py() or ()] for x in extra)
            yield pa.array([_replaced(t.as_py(), e) for t, e in zip(texts, spans, strict=True)], pa.string())

    return out.withColumn(text, run(F.col(text), F.col(more))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _masked(t: str | None, patterns: dict[str, int]) -> str | None:
    if not t or not _ANY.search(t):
        return t
    return _replaced(t, extra_spans(t, base_spans(t), patterns))


def _replaced(t: str | None, extra: list[Span]) -> str | None:
    if not t or not _ANY.search(t):
        return t
    out, at = [], 0
    for a, k, b in sorted(base_spans(t) + extra):
        if a >= at:
            out += [t[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + t[at:]
