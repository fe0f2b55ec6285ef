"""Audit of how the sources of a language differ, by sorted word pointers.

Each task takes whole texts in slices of about 4 MB, ordered by their group
(language, source). Pointers to the word starts of a slice are sorted by the
words they point at, eight bytes at a time: slices of equal bytes go on at the
next eight, as in multikey quicksort with eight bytes as one character. The
sort is stable, so an equal run (one term) is ordered by group and text, and
yields the term's occurrences and texts per group. These partial counts are
summed by Spark, combined map-side first.

A term is a run of ASCII letters and of code points from U+0080, with A-Z
lower-cased. A language keeps the terms of at least ``min_docs`` of its texts.
Shares are integers: p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)). The
divergence of two sources is the sum of abs(p - q) over all kept terms, made
per block of terms from a matrix of sources by terms, never from pairs of
sources per term.

Defined cases: NULL text, language and source are the empty string; a text
without terms still makes its group occur; a language without kept terms has
divergence 0 and no term rows; repeated rows count each time, whatever their
id; ties are ranked by the UTF-8 order of the item; words of any length are
compared whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._shared import Scratch
from ledgerlens.llm._words import LOWER, text_chunks

#: Bytes of texts that are ordered by group together, and of a slice of pointers.
GATHER_BYTES, SLICE_BYTES = 32 << 20, 4 << 20
#: Bytes of a word that are compared as numbers; the rest of longer words as a whole.
DEEP = 64
SCALE, PRIOR = 10**9, 5
#: Terms of one block of the matrix of sources by terms.
BLOCK_TERMS = 512
#: Shares of a group's terms that are ranked apart before the last ranking.
RANK_PARTS = 32

_TERM = np.ones(256, bool)
_TERM[0x00:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False


def word_pointers(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word, in text order."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = _TERM[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = np.zeros(len(buf) + 1, bool)
    end[1:] = inside[:-1] & ~inside[1:]
    edge = offs[1:-1]  # a word ends with its text
    start[edge] = inside[edge]
    met = edge[edge > 0]
    end[met] |= inside[met - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return s, e, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(s, offs)))


def _bytes_at(low: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each word as a number, in byte order; zeros
    (which no word holds) after its last byte. ``low`` ends in eight spare bytes."""
    view = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))
    cut = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
    key = (view[np.where(left > 0, at, 0)].astype(np.uint64) >> cut) << cut
    return np.where(left > 0, key, np.uint64(0))


def sorted_pointers(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the words, and a mark at the first word of every equal run."""
    size = e - s
    key = _bytes_at(low, s, size)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(s), bool)
    first[1:] = key[1:] != key[:-1]
    depth = 8
    while depth < DEEP:
        slots = _open_slots(size[order], first, depth)
        if not len(slots):
            return order, first
        p = order[slots]
        run = np.cumsum(first)[slots]
        key = _bytes_at(low, s[p] + depth, size[p] - depth)
        again = np.lexsort((key, run))
        order[slots], key = p[again], key[again]  # runs keep their slots
        first[slots[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
        depth += 8
    slots = _open_slots(size[order], first, depth)
    run = np.cumsum(first)[slots]
    for part in np.split(slots, np.flatnonzero(np.diff(run)) + 1) if len(slots) else []:
        tails = sorted((low[s[p] + depth : e[p]].tobytes(), k) for k, p in enumerate(order[part]))
        order[part] = order[part][[k for _, k in tails]]
        first[part[1:]] = [x[0] != y[0] for x, y in zip(tails[1:], tails, strict=False)]
    return order, first


def _open_slots(size: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Slots of the runs of two or more words, one of them longer than ``depth``."""
    if not len(size):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(size)))
    is_open = (count > 1) & (np.maximum.reduceat(size, at) > depth)
    return np.flatnonzero(np.repeat(is_open, count))


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _slice_counts(buf: np.ndarray, offs: np.ndarray, group: np.ndarray, langs: pa.Array, sources: pa.Array) -> pa.RecordBatch:
    """Occurrences and texts per (group, term) of one slice; texts are ordered by group."""
    s, e, text = word_pointers(buf, offs)
    low = np.zeros(len(buf) + 8, np.uint8)
    low[:-8] = LOWER[buf]
    order, first = sorted_pointers(low, s, e)
    text = text[order]
    of = group[text]
    part = first.copy()
    part[1:] |= of[1:] != of[:-1]
    at = np.flatnonzero(part)
    new = part.copy()
    new[1:] |= text[1:] != text[:-1]
    n = np.diff(np.append(at, len(order)))
    df = np.add.reduceat(new, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    lead = order[at]
    size = e[lead] - s[lead]
    to = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    chars = low[np.repeat(s[lead] - to[:-1], size) + np.arange(to[-1])]
    terms = pa.Array.from_buffers(pa.large_string(), len(lead), [None, pa.py_buffer(to), pa.py_buffer(chars)])
    g = pa.array(of[at])
    return pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), terms.cast(pa.string()), pa.array(n), pa.array(df)], schema=_COUNTS)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads columns lang, source, text (none NULL)."""

    def gathered() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= GATHER_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    for t in gathered():
        t = t.sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
        new = np.zeros(len(t), bool)
        for name in ("lang", "source"):
            code = t[name].combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        group = np.cumsum(new)
        lead = pa.array(np.flatnonzero(np.append(True, new[1:]))[: len(t)])
        langs, sources = (t[c].combine_chunks().take(lead) for c in ("lang", "source"))
        for lo, hi, buf, offs in text_chunks(t["text"], SLICE_BYTES):
            out = _slice_counts(buf, offs, group[lo:hi], langs, sources)
            for k in range(0, out.num_rows, 20_000):
                yield out.slice(k, 20_000)


def _plain(docs: DataFrame, **columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in columns.items()])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, df): occurrences, and texts that hold the term."""
    partial = _plain(docs, lang=lang, source=source, text=text).mapInArrow(
        _partial_counts, "lang string, source string, term string, n long, df long"
    )
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, lead): counts of the terms that at least
    ``min_docs`` texts of their language hold. ``lang_n`` counts the term in the
    whole language, ``lead`` is true at one row of each term. A term has a row
    per source at most."""
    term = Window.partitionBy("lang", "term")
    held = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("df").over(term).alias("_docs"),
        (F.col("source") == F.min("source").over(term)).alias("lead"),
    )
    return held.filter(F.col("_docs") >= min_docs).drop("_docs")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), in whole numbers."""
    top = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", top, (total + kept * PRIOR).cast("decimal(20,0)"))).cast("bigint")


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _block_distances(t: pa.Table) -> pa.Table:
    """One block of terms of one language: rows (lang, source, term, p), where a
    row without term holds the source's share of absent terms. The sum over the
    block of abs(p - q) for all ordered pairs of sources."""
    source, term, p = t["source"].combine_chunks(), t["term"].combine_chunks(), t["p"].to_numpy()
    row = source.dictionary_encode()
    col = term.dictionary_encode()
    base = term.is_null().to_numpy(zero_copy_only=False)
    at = row.indices.to_numpy()
    names = row.dictionary
    matrix = np.zeros((len(names), len(col.dictionary)), np.int64)
    matrix[at[base]] = p[base, None]
    matrix[at[~base], col.indices.drop_null().to_numpy()] = p[~base]
    out = []
    for k in range(len(names)):
        other = np.flatnonzero(np.arange(len(names)) != k)
        gap = np.abs(matrix[other] - matrix[k]).sum(axis=1)
        same = pa.array(np.full(len(other), k))
        lang = pa.array([t["lang"][0].as_py()] * len(other), pa.string())
        out.append(pa.Table.from_arrays([lang, names.take(same), names.take(pa.array(other)), pa.array(gap)], schema=_PAIRS))
    return pa.concat_tables(out)


def source_audit(
    docs: DataFrame, scratch: Scratch, min_docs: int = 30, top: int = 50, block_terms: int = BLOCK_TERMS,
    lang: str = "lang", source: str = "source", text: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: the divergence of
    the source from every other one of its language. Part ``term``: the ``top``
    terms that the source has more of than its language, with the difference."""
    kept = scratch.write(kept_terms(term_counts(docs, lang, source, text), min_docs))
    groups = _plain(docs, lang=lang, source=source).distinct()
    of_group = kept.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("group_total"))
    of_lang = kept.groupBy(F.col("lang").alias("m")).agg(F.sum("n").alias("lang_total"), F.sum(F.col("lead").cast("long")).alias("v"))
    totals = groups.join(of_group, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").join(
        of_lang, F.col("lang") == F.col("m"), "left"
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    # one row per group: small beside the counts, however they grow
    totals = scratch.write(totals.select("lang", "source", *map(zero, ("group_total", "lang_total", "v"))))
    blocks = F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1))
    keys = totals.select(F.col("lang").alias("l"), F.col("source").alias("s"), "group_total", "lang_total", "v", blocks.alias("blocks"))
    cells = kept.join(keys, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))).select(
        "lang", "source", "term", _share(F.col("n"), F.col("group_total"), F.col("v")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
        F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"),
    )

    absent = F.when(F.col("v") > 0, _share(F.lit(0), F.col("group_total"), F.col("v"))).otherwise(F.lit(0))
    every = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    bases = keys.select(
        F.col("l").alias("lang"), F.col("s").alias("source"), F.lit(None).cast("string").alias("term"), absent.cast("bigint").alias("p"), every.alias("block")
    )
    matrix = cells.select("lang", "source", "term", "p", "block").unionByName(bases)
    parts = matrix.groupBy("lang", "block").applyInArrow(_block_distances, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    above = cells.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = [F.desc("value"), F.asc("item")]
    # the best of every share of a group first: no task sorts a whole group
    share = F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))
    some = above.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "source", share).orderBy(*order)))
    terms = some.filter(F.col("_k") <= top).drop("_k")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))
