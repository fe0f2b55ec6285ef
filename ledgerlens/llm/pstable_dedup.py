"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised, so that cosine c is the distance sqrt(2 - 2c).
``tables`` hash tables each bucket them by ``width``-quantised Gaussian
projections; the vectors of a bucket are compared exactly (double precision)
in blocks. A pair that shares several buckets counts in the first of them
only, so links are counted without ever writing pairs: tasks emit a count per
vector and the components of their block.

Equal vectors are one class before hashing (any number of copies costs one
vector). A bucket of many different vectors is cut into blocks of ``block``
rows; each pair of blocks is a unit of work of its own, so no bucket has to fit
one task.

Recall at the threshold itself is 1 - (1 - p^bits)^tables with p the collision
probability of one projection (0.91 at cosine 0.9 for the defaults, 0.99 at
0.93, more above); no pair below the threshold is ever linked.

Vectors are scaled by a power of two before their norm is taken, so none over-
or underflows, and each dimension has buckets of its own.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite
components link with nothing; vectors of different dimensions never link; every
row comes back once, repeated rows and equal ids too (rows with one id
share a component); rows with a NULL id have no component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._graph import connected_components
from ledgerlens.llm._shared import Scratch, partitions_for, whole_partition
from ledgerlens.llm._words import mix

_MAP = pa.schema([("bucket", pa.int64()), ("tab", pa.int32()), ("cls", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("codes", pa.binary())])
_OUT = pa.schema([("cls", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def collision(distance: float, width: float) -> float:
    """Probability that one quantised projection puts two vectors together."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def _unit(vec: np.ndarray) -> np.ndarray:
    v = vec.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def codes_of(x: np.ndarray, tables: int, bits: int, width: float, seed: int) -> np.ndarray:
    """(rows, tables) 32-bit bucket codes of unit vectors."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((x.shape[1], tables * bits))
    b = rng.uniform(0, width, tables * bits)
    q = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, bits)
    h = np.zeros(q.shape[:2], np.uint64)
    for k in range(bits):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + q[:, :, k])
    return (h >> np.uint64(32)).astype(np.uint32)


def _components(near: np.ndarray) -> np.ndarray:
    """Least member index of each row's component in a symmetric link matrix."""
    label = np.arange(len(near))
    while True:
        best = np.where(near, label[None, :], len(near)).min(axis=1)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _count_links(cls, n, x, codes, tab: int, left: np.ndarray, right: np.ndarray, same: bool, threshold: float):
    """(cls, links) and star edges of one pair of blocks."""
    near = x[left] @ x[right].T >= threshold
    if same:
        np.fill_diagonal(near, False)
    earlier = near.copy()
    i, j = np.nonzero(earlier)
    if len(i) and tab:
        first = (codes[left[i], :tab] == codes[right[j], :tab]).any(axis=1)
        near[i[first], j[first]] = False
    if not near.any():
        return None
    links_l = near @ n[right]
    both = left if same else np.concatenate([left, right])
    if same:
        links, full = links_l, near
    else:
        links = np.concatenate([links_l, near.T @ n[left]])
        full = np.zeros((len(both), len(both)), bool)
        full[: len(left), len(left) :] = near
        full[len(left) :, : len(left)] = near.T
    root = _components(full)
    hit = full.any(axis=1)
    return cls[both][hit], cls[both[root]][hit], links[hit]


def near_vectors(
    rows: DataFrame, scratch: Scratch, threshold: float = 0.9, tables: int = 32, bits: int = 6, width: float = 1.0,
    block: int = 1024, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    ``bits`` should grow with the logarithm of the rows (a random pair shares a
    bucket with probability p(1.41)^bits) and ``tables`` with it."""
    v = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce((F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    v = scratch.write(v.withColumn("good", good))

    # classes of equal vectors, named by their least id
    cls = v.filter("good AND vec_id IS NOT NULL").groupBy("e").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"))
    cls = scratch.write(cls)
    total = cls.count()

    def bucketed(batches):
        for b in batches:
            sizes = np.asarray(b.column(2).value_lengths())
            for dim in np.unique(sizes):
                yield from bucketed_rows(b.take(pa.array(np.flatnonzero(sizes == dim))), int(dim))

    def bucketed_rows(b: pa.RecordBatch, dim: int):
        x = np.asarray(b.column(2).flatten()).reshape(b.num_rows, dim)
        codes = codes_of(_unit(x), tables, bits, width, seed)
        ids, n = np.asarray(b.column(0)), np.asarray(b.column(1))
        own = mix(np.array([dim], np.uint64))
        for lo in range(0, len(x), 256):
            hi = min(lo + 256, len(x))
            vec = [x[i].tobytes() for i in range(lo, hi)]
            code = [codes[i].tobytes() for i in range(lo, hi)]
            for t in range(tables):
                key = mix((codes[lo:hi, t].astype(np.uint64) + np.uint64((t + 1) << 32)) ^ own).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.full(hi - lo, t, np.int32)), pa.array(ids[lo:hi]), pa.array(n[lo:hi]), pa.array(vec, pa.binary()), pa.array(code, pa.binary())], schema=_MAP
                )

    ddl = "bucket long, tab int, cls long, n long, vec binary, codes binary"
    buckets = cls.select("cls", "n", "e").mapInArrow(bucketed, ddl)
    # sizes first: a bucket of one is dropped, a large one is cut into blocks
    sizes = cls.select("cls", "n", "e").mapInArrow(lambda it: (b.select(["bucket", "cls"]) for b in bucketed(it)), "bucket long, cls long")
    sizes = sizes.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = scratch.write(sizes.select(F.col("bucket").alias("s_bucket"), "size"))
    b = buckets.join(sizes, F.col("bucket") == F.col("s_bucket"))
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    b = b.withColumn("blocks", blocks).withColumn("own", own)
    # a vector goes to every pair of blocks that holds its own
    b = b.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    b = b.withColumn("unit", F.xxhash64("bucket", F.least("own", "mate"), F.greatest("own", "mate")))
    b = b.select("unit", "tab", "cls", "n", "vec", "codes", "own", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"))

    def compare(t: pa.Table) -> pa.Table:
        unit = np.asarray(t.column("unit"))
        order = np.argsort(unit, kind="stable")
        t = t.take(pa.array(order))
        unit = unit[order]
        ids, n, tab, own, lo, hi = (np.asarray(t.column(c)) for c in ("cls", "n", "tab", "own", "lo", "hi"))
        vec, code = t.column("vec").combine_chunks(), t.column("codes").combine_chunks()
        cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
        out: list[tuple] = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            raw = vec[s:e].to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):  # one, unless hashes of two dimensions collide
                at = np.flatnonzero(sizes == size)
                if len(at) < 2:
                    continue
                x = _unit(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1))
                at += s
                c = np.frombuffer(b"".join(code.take(pa.array(at)).to_pylist()), np.uint32).reshape(len(at), tables)
                same = lo[s] == hi[s]
                left = np.flatnonzero(own[at] == lo[s])
                right = left if same else np.flatnonzero(own[at] == hi[s])
                if len(left) and len(right) and (r := _count_links(ids[at], n[at], x, c, int(tab[s]), left, right, same, threshold)):
                    out.append(r)
        if not out:
            return _OUT.empty_table()
        # one row per class and star centre of this task
        a, o, k = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table([a, o, k], schema=_OUT).group_by(["cls", "other"]).aggregate([("links", "sum")]).rename_columns(_OUT.names)

    tasks = partitions_for(total * tables, 40_000)
    found = b.repartition(tasks, "unit").mapInArrow(whole_partition(compare, _OUT), "cls long, other long, links long")
    found = scratch.write(found)
    comp = connected_components(found.filter("cls <> other").select("cls", "other").distinct(), scratch)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    cls2 = cls.select("e", "n", F.col("cls").alias("c"))
    cls2 = cls2.join(links, F.col("c") == F.col("cls"), "left").drop("cls").join(comp, F.col("c") == F.col("v"), "left")
    cls2 = cls2.select("c", F.col("e").alias("ce"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("l"), F.coalesce("component", "c").alias("k"))
    out = v.join(scratch.write(cls2), F.col("good") & (F.col("e") == F.col("ce")), "left")
    component = F.coalesce("k", "vec_id")
    return out.select(
        "vec_id", F.coalesce("l", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
