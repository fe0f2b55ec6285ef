"""Stupid-backoff scores of every document under the corpus's own n-grams.

    S(w | u v) = c(u v w) / c(u v)           if another document has "u v w"
               = backoff * S(w | v)          otherwise
    S(w | v)   = c(v w) / c(v)               if another document has "v w"
               = backoff * c(w) / N          otherwise
    S(w)       = c(w) / N                    for the first word of a text

The second word of a text starts at its bigram, without a factor. Trigram,
bigram and context counts leave out the document that is scored (else every
n-gram of a text would be known); c(w) and N are those of the whole corpus.
Words are lower-cased (A-Z) and compared by 64-bit hashes, n-grams by 64-bit
hashes of those.

All steps are grouped and dealt by Spark. Texts are grouped into chunks, and a
chunk asks for its words and bigrams, each once with its count there, in one row
per range of n-gram hashes ("part"). The rows of a part are grouped, counts of
equal n-grams summed, and every row is answered by the sums in its own order.
Chunks and their answers are cogrouped and ask for trigrams likewise: for those
whose two bigrams other documents have, as no other trigram can be known. Chunks
and all answers are cogrouped, the counts of the document itself are taken off
and its scores summed. A row per n-gram and document would move some six times
as much (README).

A frequent word is no hot key: an n-gram is one entry per chunk, whatever its
count, and a word's bigrams and trigrams are dealt by their own hashes. Rows are
dealt to chunks by their place in the table, so copies are spread.

Defined cases: NULL and wordless texts have no tokens, score 0 and a NULL mean;
a text is held whole in one task, so the longest one bounds its memory, and is
scored whole; repeated rows and equal ids are scored one by one (they know each
other); NULL ids are scored; an empty table gives an empty result; other
columns are ignored. Scores of ties do not depend on the order of rows, but for
the last bits of a sum of doubles.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._shared import Scratch, partitions_for, text_bytes
from ledgerlens.llm._words import mix, text_chunks, words

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_TEXT_DDL = "chunk long, doc_id long, size int, z binary"
_ASK_DDL = "chunk long, part int, n int, mark long, grams binary, counts binary"
_ANSWER_DDL = "chunk long, part int, n int, mark long, counts binary"
_SCORE_DDL = "doc_id long, n_tokens long, n_backoff long, n_unigram long, log_score double"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
_TEXT, _ASK, _ANSWER, _SCORE = (
    pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))]) for ddl in (_TEXT_DDL, _ASK_DDL, _ANSWER_DDL, _SCORE_DDL)
)


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte: high bytes, nearly all zero, take no room."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(_U).ravel()


def _sum(keys: np.ndarray) -> int:
    """By which a row's n-grams are known again, modulo 2**64."""
    return int(keys.sum(dtype=_U).view(np.int64))


def _before(x: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """The value ``k`` words earlier in the same document, 0 where there is none."""
    out = np.zeros_like(x)
    out[k:] = np.where(doc[k:] == doc[:-k], x[:-k], 0)
    return out


def _compress(batches):
    """Texts as they are moved; NULL is the empty text."""
    for b in batches:
        plain = [x.as_py() or b"" for x in b.column("t").cast(pa.binary())]
        packed = pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in plain], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("doc_id"), pa.array(map(len, plain), pa.int32()), packed], schema=_TEXT)


def _grams(texts: pa.Table, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The document of every word, and for each length the places of the last
    words of n-grams and the hashes of these."""
    sizes = texts.column("size").to_pylist()
    plain = [pa.decompress(z.as_py(), n, codec="zstd", asbytes=True) if n else b"" for z, n in zip(texts.column("z"), sizes, strict=True)]
    found = [(h, doc + lo) for lo, _, buf, offs in text_chunks(pa.array(plain, pa.large_binary())) for h, doc in (words(buf, offs),)]
    h, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    h = np.maximum(h, _U(1))
    out, key = [], mix(h)
    for k in range(order):
        earlier = _before(h, doc, k) if k else h
        key = mix(key * _K + earlier) if k else key
        at = np.flatnonzero(earlier)
        out.append((at, key[at]))
    return doc, out


def _runs(ordered: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values (in all arrays)."""
    new = np.ones(len(ordered), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (ordered, *more)], axis=0)
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(ordered)))


def _questions(chunk: int, hashes: list[np.ndarray], parts: int, first: int) -> pa.Table:
    """The distinct n-grams of a chunk, in order of their hashes, with their
    counts, one row per part; parts are numbered from ``first``."""
    ordered = np.sort(np.concatenate(hashes))
    start, n = _runs(ordered)
    key, n = ordered[start], n.astype(_U)
    edge = np.searchsorted((key >> _U(32)) * _U(parts) >> _U(32), np.arange(parts + 1, dtype=_U)).tolist()
    rows = [
        (chunk, first + p, hi - lo, _sum(key[lo:hi]), pack(np.diff(key[lo:hi], prepend=_U(0))), pack(n[lo:hi]))
        for p, (lo, hi) in enumerate(pairwise(edge)) if hi > lo
    ]
    return pa.Table.from_pylist([dict(zip(_ASK.names, r, strict=True)) for r in rows], schema=_ASK)


def _answer(asked: pa.Table) -> pa.Table:
    """The sums of a part's counts, for every row in the order of its n-grams."""
    n = asked.column("n").to_pylist()
    keys = [np.cumsum(unpack(x.as_py(), k), dtype=_U) for x, k in zip(asked.column("grams"), n, strict=True)]
    ordered = np.sort(np.concatenate(keys))
    ordered = ordered[_runs(ordered)[0]]
    at = [np.searchsorted(ordered, k).astype(np.int32) for k in keys]
    keys.clear()
    total = np.zeros(len(ordered), _U)
    for place, x, k in zip(at, asked.column("counts"), n, strict=True):
        total[place] += unpack(x.as_py(), k)
    counts = pa.array([pack(total[x]) for x in at], pa.binary())
    return pa.Table.from_arrays([*(asked.column(c) for c in _ANSWER.names[:4]), counts], schema=_ANSWER)


def _look_up(doc: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], answers: pa.Table, parts: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, by place: the count in the corpus and that in other
    documents, from the answers of ``parts``."""
    key = np.sort(np.concatenate([k for _, k in grams]))
    key = key[_runs(key)[0]]
    rows = sorted(r for r in zip(*(answers.column(c).to_pylist() for c in _ANSWER.names[1:]), strict=True) if r[0] in parts)
    edge = np.cumsum([0, *(n for _, n, *_ in rows)]).tolist()
    if edge[-1] != len(key) or any(_sum(key[lo:hi]) != r[2] for r, (lo, hi) in zip(rows, pairwise(edge), strict=True)):
        raise ValueError("the rows of the table changed while it was read; store it before")
    total = np.concatenate([np.zeros(0, _U), *(unpack(x, n) for _, n, _, x in rows)]).astype(np.int64)
    out = []
    for at, k in grams:
        by = np.argsort(k, kind="stable")  # words stay in order, so a document's are together
        k, at = k[by], at[by]
        start, size = _runs(k)
        corpus, others = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        corpus[at] = np.repeat(total[np.searchsorted(key, k[start])], size)
        own = _runs(k, doc[at])[1]
        others[at] = corpus[at] - np.repeat(own, own)
        out.append((corpus, others))
    return out


def _possible(doc: np.ndarray, two: np.ndarray, trigrams: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams both bigrams of which another document has."""
    at, k = trigrams
    keep = ((two > 0) & (_before(two, doc, 1) > 0))[at]
    return at[keep], k[keep]


def _ask(parts: int):
    def run(texts: pa.Table) -> pa.Table:
        return _questions(texts.column("chunk")[0].as_py(), [k for _, k in _grams(texts, 2)[1]], parts, 0)

    return run


def _ask_trigrams(parts: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        doc, grams = _grams(texts, 3)
        two = _look_up(doc, grams[:2], answers, range(parts))[1][1]
        return _questions(texts.column("chunk")[0].as_py(), [_possible(doc, two, grams[2])[1]], parts, parts)

    return run


def _score(order: int, backoff: float, parts: int):
    """The scores of a chunk's documents, without the N of single words."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        doc, grams = _grams(texts, order)
        (corpus, one), (_, two) = _look_up(doc, grams[:2], answers, range(parts))
        three = np.zeros_like(two)
        if order > 2:
            three = _look_up(doc, [_possible(doc, two, grams[2])], answers, range(parts, 2 * parts))[0][1]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)  # in its text
        by3, by2 = three > 0, (three <= 0) & (two > 0)
        context = np.where(by3, _before(two, doc, 1), np.where(by2, _before(one, doc, 1), 1))
        share = np.where(by3, three, np.where(by2, two, corpus)) / context
        steps = np.where(by3, 0, np.minimum(place, order - 1) - by2)
        fell = ~by3 & ~by2 & (place > 0)
        count = lambda x=None: np.bincount(doc, x, minlength=len(texts))
        columns = [x.astype(np.int64) for x in (count(), count(steps > 0), count(fell))]
        columns.append(count(np.log(share) + steps * math.log(backoff)))
        return pa.Table.from_arrays([texts.column("doc_id"), *map(pa.array, columns)], schema=_SCORE)

    return run


def stupid_backoff(
    docs: DataFrame, scratch: Scratch, backoff: float = 0.4, doc_id: str = "doc_id", text: str = "text",
    order: int = 3, chunk_bytes: int = 1 << 23, bytes_per_part: int = 1 << 24,
) -> DataFrame:
    """doc_id, n_tokens, n_backoff (tokens that back off at all), n_unigram (down
    to the word alone), log_score (natural log, summed), mean_score. ``order``
    is 3 (trigrams) or 2 (bigrams). A chunk holds about ``chunk_bytes`` of text,
    a part the n-grams of about ``bytes_per_part``."""
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order!r}")
    size = text_bytes(docs, text)
    parts = partitions_for(size, bytes_per_part)
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(partitions_for(size, chunk_bytes)))
    texts = docs.select(chunk.alias("chunk"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    texts = texts.mapInArrow(_compress, _TEXT_DDL).groupBy("chunk")
    answer = lambda asked: asked.groupBy("part").applyInArrow(_answer, _ANSWER_DDL)
    # one plan, so that Spark moves the texts once and reuses that exchange
    answers = answer(texts.applyInArrow(_ask(parts), _ASK_DDL))
    if order > 2:
        answers = answers.union(answer(texts.cogroup(answers.groupBy("chunk")).applyInArrow(_ask_trigrams(parts), _ASK_DDL)))
    scored = scratch.write(texts.cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, backoff, parts), _SCORE_DDL))
    total = scored.agg(F.sum("n_tokens")).first()[0] or 1
    alone = F.col("n_unigram") + F.when(F.col("n_tokens") > 0, 1).otherwise(0)  # the first word, too
    return scored.withColumn("log_score", F.col("log_score") - alone * F.lit(math.log(total))).withColumn(
        "mean_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
    )
