"""Toxic passages by maximum-scoring segments.

Tokens (words, and word beginnings for words not seen in training) get
log-odds of toxic against clean documents under an informative Dirichlet
prior. A linear-time scan (Ruzzo-Tompa) finds every maximal segment of a
text's token scores; segments are calibrated as extreme values
(Karlin-Altschul: E = K n exp(-lambda S)) and a document's evidence is the
sum of -ln E over its significant segments, mapped to a probability. The scan
scores every occurrence of a token, so every significant segment is found;
only the evidence is damped: within a segment a token counts ``REPEATS``
times, and so do segments of the same tokens within a text.

The model is fitted on at most ``max_labelled`` labelled rows of each class,
the first in hash order (a bounded sample; the bound is a parameter); scoring
covers every text whole.

Defined cases: NULL and empty texts have no evidence and get the base rate;
very long texts are scanned whole, in time linear in their tokens; of tokens
that score alike none comes first, all that reach the bounds are kept;
labels that are NULL or whose doc_id is NULL are not used; a document with
contradicting labels counts as toxic; without labels of both classes every
score is the smoothed base rate; repeated rows are scored one by one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[^\W\d_]+"
PREFIXES = (8, 7, 6, 5, 4, 3)
REPEATS = 2  # occurrences of a token in a segment, and of a set of tokens over segments, that count as evidence
_TOKEN = re.compile(TOKEN)


@dataclass(frozen=True)
class ToxicModel:
    weights: dict[str, float]  # of tokens; a word beginning ends in "*"
    gap: float  # score of every other token, negative
    lam: float  # Karlin-Altschul lambda
    k: float
    intercept: float
    slope: float


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def maximal_segments(positions: list[int], weights: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score) of a sequence
    that scores ``weights`` at ``positions`` and ``gap`` < 0 elsewhere, in time
    linear in the number of positions."""
    segs: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total at the end, next on the left of lower total before
    total, last = 0.0, -1
    for p, w in zip(positions, weights, strict=True):
        total += gap * (p - last - 1)
        last = p
        first, before, j = p, total, len(segs) - 1
        total += w
        while True:
            # whatever lies between a segment and its lower one is not lower either
            while j >= 0 and segs[j][2] >= before:
                j = segs[j][4]
            if j < 0 or segs[j][3] >= total:
                # segments between j and the new one stay: it does not absorb them
                segs.append((first, p + 1, before, total, j))
                break
            first, _, before, _, lower = segs[j]
            del segs[j:]
            j = lower
    return [(a, b, r - l) for a, b, l, r, _ in segs]


def token_weight(word: str, weights: dict[str, float]) -> float:
    w = weights.get(word)
    if w is None:
        w = max((weights.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k), default=0.0)
    return w


def _scan(text: str, model: ToxicModel) -> tuple[list[str], list[int], list[float], list[tuple[int, int, float, float]]]:
    """Tokens, places and scores of those that count, and every maximal segment
    (first token, end, score, E-value)."""
    toks = _TOKEN.findall(text.lower())
    cache: dict[str, float] = {}
    hits, vals = [], []
    for i, t in enumerate(toks):
        w = cache.get(t)
        if w is None:
            w = cache[t] = token_weight(t, model.weights)
        if w > 0:
            hits.append(i)
            vals.append(w)
    n = max(1, len(toks))
    return toks, hits, vals, [(a, b, s, model.k * n * math.exp(-model.lam * s)) for a, b, s in maximal_segments(hits, vals, model.gap)]


def passages(text: str, model: ToxicModel) -> tuple[list[tuple[int, int, float, float]], int]:
    """(first token, end, score, E-value) of every maximal segment; number of tokens."""
    toks, _, _, found = _scan(text, model)
    return found, len(toks)


def evidence(text: str | None, model: ToxicModel) -> float:
    """A text that repeats one word or passage over and over says it only so often."""
    toks, hits, vals, found = _scan(text or "", model)
    n = max(1, len(toks))
    values: dict[frozenset[str], list[float]] = {}
    for a, b, s, e in found:
        if e >= 1:
            continue
        seen: dict[str, int] = {}
        for k in range(bisect_left(hits, a), bisect_left(hits, b)):
            t = toks[hits[k]]
            seen[t] = seen.get(t, 0) + 1
            if seen[t] > REPEATS:
                s -= vals[k] - model.gap
        # -ln E, at most that of 1e-12; a much repeated passage's damped score can be far below zero
        values.setdefault(frozenset(seen), []).append(min(model.lam * s - math.log(model.k * n), 12 * math.log(10)))
    return sum(sum(v for v in sorted(x)[-REPEATS:] if v > 0) for x in values.values())


def _sample(labels: DataFrame, max_labelled: int) -> DataFrame:
    one = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    one = one.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return one.filter("toxic = 1").orderBy(*order).limit(max_labelled).union(one.filter("toxic = 0").orderBy(*order).limit(max_labelled))


def _beginnings(words: Column, k: int) -> Column:
    return F.transform(F.filter(words, lambda x: F.length(x) > k), lambda x: F.concat(F.substring(x, 1, k), F.lit("*")))


def _lambda(weights: np.ndarray, rates: np.ndarray, gap: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the clean background."""
    rest = max(1e-9, 1 - rates.sum())
    f = lambda x: float((rates * np.exp(np.minimum(x * weights, 600))).sum() + rest * math.exp(x * gap)) - 1
    lo, hi = 1e-6, 1e-6
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by damped Newton steps with a weak ridge."""
    a, b = 0.0, 0.0
    z = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * np.array([0, b])
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a, max(b, 0.0)


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 10_000, prior: float = 200.0,
    min_z: float = 4.0, min_odds: float = 20.0, min_docs: int = 4, gap: float = -0.05,
) -> ToxicModel:
    """Count tokens (once a document) over three quarters of the sample, keep
    those whose log-odds stand out by ``min_z`` standard errors and reach
    ``min_odds``, and map
    evidence to a probability on the last quarter. The table of tokens has as
    many rows as the sample has such words; it does not grow with ``docs``."""
    train = docs.select(F.col("doc_id").alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("t")).join(
        # at most 2 * max_labelled rows of two numbers: a proven bound
        F.broadcast(_sample(labels, max_labelled).withColumnRenamed("doc_id", "l")), F.col("d") == F.col("l")
    ).select("d", "t", "toxic", (F.pmod(F.xxhash64(F.lit("fold"), "d"), F.lit(4)) == 0).alias("calibrate")).persist()
    words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit("\\p{L}+"), F.lit(0)))
    starts = [_beginnings(F.col("w"), k) for k in PREFIXES]
    fitted = train.filter("NOT calibrate").withColumn("w", words)
    sizes = {r["toxic"]: (r["n"], r["t"]) for r in fitted.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size("w")).alias("t")).collect()}
    (d1, n1), (d0, n0) = sizes.get(1, (0, 0)), sizes.get(0, (0, 0))
    base = train.agg(F.avg("toxic").alias("m"), F.count("*").alias("n")).first()
    rate = ((base["m"] or 0.0) * base["n"] + 0.5) / (base["n"] + 1)
    flat = ToxicModel({}, gap, 1.0, 1.0, math.log(rate / (1 - rate)), 0.0)
    if not d1 or not d0 or not n1 or not n0:
        train.unpersist()
        return flat
    counts = fitted.select("toxic", F.explode(F.array_distinct(F.concat("w", *starts))).alias("token")).groupBy("token").agg(
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("y0")
    )
    share = F.lit(float(prior)) * (F.col("y1") + F.col("y0")) / F.lit(float(n1 + n0))
    # half a count besides the prior's share keeps tokens that one class lacks comparable
    a1, a0 = F.col("y1") + share + 0.5, F.col("y0") + share + 0.5
    delta = F.log(a1 / (n1 + prior - a1)) - F.log(a0 / (n0 + prior - a0))
    scored = counts.filter(F.col("y1") >= min_docs).select("token", "y0", delta.alias("delta"), (delta / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
    kept = scored.filter((F.col("z") >= min_z) & (F.col("delta") >= math.log(min_odds))).orderBy(F.desc("z"), "token").collect()
    weights = {r["token"]: float(r["delta"]) for r in kept}
    if not weights:
        train.unpersist()
        return flat
    rates = np.array([(r["y0"] + 0.5) / n0 for r in kept])
    whole = np.array([not r["token"].endswith("*") for r in kept])
    w = np.array([r["delta"] for r in kept])
    use = whole if whole.any() else ~whole
    lam = _lambda(w[use], rates[use] * min(1.0, 0.5 / max(rates[use].sum(), 1e-9)), gap)
    model = ToxicModel(weights, gap, lam, 0.1, 0.0, 1.0)
    seen = train.filter("calibrate").select("toxic", evidence_column(F.col("t"), model).alias("x")).collect()
    train.unpersist()
    if not seen or len({r["toxic"] for r in seen}) < 2:
        return ToxicModel(weights, gap, lam, 0.1, -3.0, 1.0)
    a, b = _logistic(np.array([r["x"] for r in seen]), np.array([float(r["toxic"]) for r in seen]))
    # the sample holds both classes in other shares than the corpus may; it is kept as fitted
    return ToxicModel(weights, gap, lam, 0.1, a, b)


def evidence_column(text: Column, model: ToxicModel) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([evidence(x.as_py(), model) for x in b], pa.float64())

    return run(text)


def toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of every row."""
    out = docs.select("doc_id", evidence_column(F.col("text"), model).alias("evidence"))
    score = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.least(F.col("evidence"), F.lit(600.0)))))
    out = out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def toxic_passages(docs: DataFrame, model: ToxicModel, max_e: float = 1.0) -> DataFrame:
    """Every significant passage: doc_id, first and end token, score, E-value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (d, *p)
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for p in passages(t or "", model)[0]
                if p[3] < max_e
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "first_token", "end_token", "score", "e_value"), r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("first_token", pa.int64()), ("end_token", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, first_token long, end_token long, score double, e_value double")
