"""Exact Jaccard join of word n-gram sets by universe partition and pigeonhole.

Sets of distinct shingle hashes are grouped into size bands such that linked
sets lie in one band or in two neighbouring ones. For a band, linked sets
differ in at most H elements; the hash universe is cut into m segments, and of
m segments K also index their one-deletion neighbourhoods, with m + K = H + 1
chosen by a cost model (signatures written against unselective segments). If
no segment of a pair agreed, and none of the K nearly, the sets would differ
in more than H elements, so every linked pair shares a signature. Empty
segments carry no signature; a set with e empty segments indexes e more
neighbourhoods instead, which restores the bound (see ``signatures``).

Signatures are dealt out by hash as compact blocks; what two or more different
sets share becomes rows. Candidates are verified exactly, members of a
signature first against its least member; where members are still in different
components, the pairs of a small signature become rows, and the sets of a large
one meet in pairs of blocks and are compared there; the members that already
are its commonest component meet the others only. Nothing writes the pairs of
a group of copies: equal sets are one class from the start, and near copies
link through the least member or inside a block.

Before any two sets are read, their parity sketches are compared: 512 bits, one
flipped by every element. Each bit in which two sketches differ needs an
element that only one of the sets has, so sketches that differ in more bits
than linked sets may differ in elements rule a pair out exactly. What is left
is compared by wide sketches, of about one bit an element, which tell long sets
apart too; only the sets of pairs that pass both are made and moved.

Defined cases: NULL and wordless texts have an empty set and link with
nothing; fewer words than n form one shingle; NULL ids get no component and
link with nothing; rows that repeat an id are one document (the union of its
rows' links); ties go to the smaller id; an empty table gives an empty result;
other columns are ignored. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._graph import connected_components
from ledgerlens.llm._shared import Scratch, partitions_for, text_bytes, whole_partition
from ledgerlens.llm._words import mix, ngrams, sequence_hash, text_chunks, words

_U = np.uint64
_SEG = _U(0xC2B2AE3D27D4EB4F)
SMALL = 64  # members of a signature up to which its pairs become rows
# A sort takes a page of memory (16 MB on small executors) for each side of a
# join, however few rows a task has. Where every partition of a side is small,
# adaptive execution makes a hash table of it instead; others are sorted.
SMALL_JOINS = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(16 << 20)}


# -- bands and plans -------------------------------------------------------


def band_starts(percent: int, largest: int) -> list[int]:
    """First size of every band: a set of band b links only with b-1, b, b+1."""
    starts = [1]
    last = 2
    while starts[-1] <= largest:
        starts.append(last)
        last = max(last + 1, (last - 1) * 100 // percent + 1)
    return starts


def plan(differ: int, size: int, weight: float = 4.0, most: int = 4) -> tuple[int, int]:
    """(segments, one-deletion segments) with segments + K = differ + 1 of least
    cost: signatures of a set plus an estimate of useless agreement, which
    falls by half with every element that a segment holds."""
    best = None
    for k in range(min(most, (differ + 1) // 2) + 1):
        m = differ + 1 - k
        per = size / m
        cost = m + k * (1 + per) + weight * m * 2.0 ** (-per)
        if best is None or cost < best[0]:
            best = (cost, m, k)
    return best[1], best[2]


class Bands:
    def __init__(self, percent: int, largest: int):
        self.percent = percent
        self.starts = np.array(band_starts(percent, max(largest, 1)), np.int64)
        self.m, self.k = [], []
        for b in range(len(self.starts)):
            hi = int(self.starts[b + 1]) - 1 if b + 1 < len(self.starts) else int(self.starts[b])
            m, k = plan((100 - percent) * hi // percent, int(self.starts[b]))
            self.m.append(m)
            self.k.append(k)
        self.m, self.k = np.array(self.m, np.int64), np.array(self.k, np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, size, "right") - 1


def _sums(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Exact sums modulo 2^64 of ``value`` by ``group`` (32-bit halves as floats)."""
    lo = np.bincount(group, (value & _U(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    hi = np.bincount(group, (value >> _U(32)).astype(np.float64), n).astype(np.uint64)
    return lo + (hi << _U(32))


def signatures(h: np.ndarray, doc: np.ndarray, ndocs: int, bands: Bands, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of sets given as (hash, document) pairs, under the
    plan of ``band`` (one per document; documents without elements have none).

    Exact signatures of all segments that are not empty; one-deletion
    neighbourhoods of the first K + e segments that hold two elements or more,
    e being the number of empty ones. Two sets whose c common empty segments
    cannot speak differ in the others; more than K + c - 1 of these cannot
    differ twice, so among the first K + c that are not thin (one element at
    most) in both sets one differs by a single element and is found. A set with
    fewer such segments than it needs gets a signature for its band instead."""
    size = np.bincount(doc, minlength=ndocs)
    live = np.flatnonzero(size > 0)
    m = np.zeros(ndocs, np.int64)
    m[live] = bands.m[band[live]]
    base = np.concatenate([[0], np.cumsum(m)])
    seg = ((h >> _U(11)) % np.maximum(m, 1).astype(np.uint64)[doc]).astype(np.int64)
    cell = base[doc] + seg
    value = mix(h)
    sums, count = _sums(cell, value, base[-1]), np.bincount(cell, minlength=base[-1])
    owner = np.repeat(np.arange(ndocs), m)
    place = np.arange(base[-1]) - base[owner]
    salt = mix(band[owner].astype(np.uint64) * _SEG + place.astype(np.uint64) + _U(1))
    exact = count > 0
    sig, own = [mix(sums[exact] + salt[exact])], [owner[exact]]
    empty = np.bincount(owner[~exact], minlength=ndocs)
    need = np.where(size > 0, bands.k[band] + empty, 0)
    thick = count >= 2
    rank = np.cumsum(thick) - thick
    rank -= np.concatenate([[0], np.cumsum(thick)])[base[owner]]
    chosen = thick & (rank < need[owner])
    if chosen.any():
        el = chosen[cell]
        sig.append(mix(sums[cell[el]] - value[el] + salt[cell[el]]))
        own.append(doc[el])
    odd = np.flatnonzero((np.bincount(owner[thick], minlength=ndocs) < need) & (size > 1))
    if len(odd):
        sig.append(mix(band[odd].astype(np.uint64) + _U(0x5DEECE66D)))
        own.append(odd)
    return np.concatenate(sig), np.concatenate(own)


# -- shingle sets ----------------------------------------------------------


def shingle_sets(col: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hash, document) per chunk: the distinct shingles of
    every row, sorted by document and hash."""
    for lo, hi, buf, offs in text_chunks(col):
        w, d = words(buf, offs)
        g, gd = ngrams(w, d, n)
        per = np.bincount(d, minlength=hi - lo)
        short = np.flatnonzero((per > 0) & (per < n))
        if len(short):
            at = np.concatenate([[0], np.cumsum(per)])
            extra = np.array([sequence_hash(w[at[i] : at[i + 1]]) for i in short], np.uint64)
            g, gd = np.concatenate([g, extra]), np.concatenate([gd, short])
        order = np.lexsort((g, gd))
        g, gd = g[order], gd[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
        yield lo, hi, g[keep], gd[keep]


def _set_hash(g: np.ndarray, gd: np.ndarray, ndocs: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(gd, minlength=ndocs)
    return mix(_sums(gd, mix(g + _SEG), ndocs) + size.astype(np.uint64)).view(np.int64), size


SKETCH = [f"s{k}" for k in range(8)]


def sketches(g: np.ndarray, gd: np.ndarray, ndocs: int) -> np.ndarray:
    """Parity sketch of every set, as eight words of 64 bits."""
    bits = np.bincount(gd * 512 + ((g >> _U(20)) & _U(511)).astype(np.int64), minlength=ndocs * 512) & 1
    return np.packbits(bits.astype(bool)).view(np.int64).reshape(ndocs, 8)


def wide_sketch(g: np.ndarray) -> bytes:
    """Parity sketch of one set in a power of two of bits, one for an element at
    least: an eighth of a byte where the set itself takes eight."""
    bits = max(512, 1 << (len(g) - 1).bit_length())
    return np.packbits((np.bincount(((g >> _U(20)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set in ``size`` bytes, a smaller power of two."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def document_sets(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, cls (hash of the set), size, parity sketch, wide sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("size", pa.int64()), *[(c, pa.int64()) for c in SKETCH], ("wide", pa.binary())])

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for lo, hi, g, gd in shingle_sets(b.column(1), n):
                cls, size = _set_hash(g, gd, hi - lo)
                words = [pa.array(x) for x in sketches(g, gd, hi - lo).T.copy()]
                at = np.concatenate([[0], np.cumsum(size)]).tolist()
                wide = pa.array([wide_sketch(g[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(cls), pa.array(size.astype(np.int64)), *words, wide], schema=schema)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, cls long, size long, " + ", ".join(f"{c} long" for c in SKETCH) + ", wide binary")


def _signature_blocks(docs: DataFrame, n: int, text: str, bands: Bands, parts: int) -> DataFrame:
    """(part, sig, cls) blocks: parallel binary arrays of one chunk, each class
    once per chunk."""
    schema = pa.schema([("part", pa.int32()), ("sig", pa.binary()), ("cls", pa.binary())])

    def run(batches):
        for b in batches:
            for lo, hi, g, gd in shingle_sets(b.column(0), n):
                cls, size = _set_hash(g, gd, hi - lo)
                _, first = np.unique(cls, return_index=True)
                once = np.zeros(hi - lo, bool)
                once[first] = True
                use = once[gd]
                g, gd = g[use], gd[use]
                own = bands.of(np.maximum(size, 1))
                found = [signatures(g, gd, hi - lo, bands, own)]
                up = (own > 0)[gd]
                found.append(signatures(g[up], gd[up], hi - lo, bands, np.maximum(own - 1, 0)))
                sig, doc = (np.concatenate(z) for z in zip(*found, strict=True))
                part = ((sig >> _U(40)) % _U(parts)).astype(np.int64)
                order = np.lexsort((doc, part))
                sig, doc, part = sig[order], doc[order], part[order]
                cut = np.searchsorted(part, np.arange(parts + 1))
                rows = [(int(p), sig[cut[p] : cut[p + 1]].tobytes(), cls[doc[cut[p] : cut[p + 1]]].tobytes()) for p in np.flatnonzero(cut[1:] > cut[:-1])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "part int, sig binary, cls binary")


_SHARED = pa.schema([("sig", pa.int64()), ("cls", pa.int64())])


def _shared_signatures(t: pa.Table) -> pa.Table:
    """Rows (sig, cls) of signatures that two or more classes have."""
    part = np.asarray(t.column("part"))
    out = []
    for p in np.unique(part):
        at = np.flatnonzero(part == p).tolist()
        sig = np.concatenate([np.frombuffer(t.column("sig")[i].as_buffer(), np.uint64) for i in at])
        cls = np.concatenate([np.frombuffer(t.column("cls")[i].as_buffer(), np.int64) for i in at])
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        twice = np.zeros(len(sig), bool)
        twice[1:] |= same
        twice[:-1] |= same
        sig, cls = sig[twice], cls[order[twice]]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[keep], cls[keep]
        same = sig[1:] == sig[:-1]
        twice = np.zeros(len(sig), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out.append(pa.table([sig[twice].view(np.int64), cls[twice]], schema=_SHARED))
    return pa.concat_tables(out) if out else _SHARED.empty_table()


# -- verification ----------------------------------------------------------


def _blobs(docs: DataFrame, reps: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """(cls, set as sorted hashes) of the classes ``reps`` (cls, rep)."""
    schema = pa.schema([("cls", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        for b in batches:
            for lo, hi, g, gd in shingle_sets(b.column(0), n):
                cls, size = _set_hash(g, gd, hi - lo)
                at = np.concatenate([[0], np.cumsum(size)])
                blob = [g[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(blob, pa.binary())], schema=schema)

    texts = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).join(reps, F.col("d") == F.col("rep"), "left_semi")
    rows = texts.select("t").mapInArrow(run, "cls long, blob binary")
    # other rows of the same ids may hold other sets
    return rows.join(reps.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("blob").alias("blob"))


class Sets:
    """The classes' sizes and sketches, and the sets themselves of those classes
    that a step has asked for: most candidates go by their sketches."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, doc_id: str, text: str, percent: int, scratch: Scratch):
        self.docs, self.classes, self.n, self.doc_id, self.text = docs, classes, n, doc_id, text
        self.percent, self.scratch, self.made = percent, scratch, []

    def want(self, cls: DataFrame) -> None:
        reps = self.classes.select("cls", "rep").join(cls.distinct(), "cls", "left_semi")
        for made in self.made:
            reps = reps.join(made.select("cls"), "cls", "left_anti")
        reps = self.scratch.write(reps)
        self.made.append(self.scratch.write(_blobs(self.docs, reps, self.n, self.doc_id, self.text), batch_rows=2000))
        self.scratch.drop(reps)

    def all(self) -> DataFrame:
        out = self.made[0]
        for made in self.made[1:]:
            out = out.union(made)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of the stored pairs (a, b): by wide sketches first,
        then by the sets of the pairs that are left."""
        near = self.scratch.write(_likely_wide(pairs, self.classes, self.percent))
        ends = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
        self.want(ends)
        out = self.scratch.write(_verified(near, self.all().join(ends, "cls", "left_semi"), self.percent), batch_rows=500)
        self.scratch.drop(near)
        return out

    def drop(self) -> None:
        self.scratch.drop(*self.made)


def _sketch_of(blobs: DataFrame, x: str) -> DataFrame:
    """(x, size_x, sketch columns ending in _x)"""
    return blobs.select(F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in SKETCH])


def _may_link(percent: int):
    """True for every linked pair: sizes agree, and the sketches differ in no
    more bits than the sets may in elements."""
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    return _sizes_agree(percent) & ((100 + percent) * differ <= (100 - percent) * (F.col("size_a") + F.col("size_b")))


def _likely(pairs: DataFrame, blobs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches leave."""
    p = pairs.join(_sketch_of(blobs, "b"), "b")
    near = (p["a"] == F.col("a_cls")) & _may_link(percent)
    return p.join(_sketch_of(blobs, "a").withColumnRenamed("a", "a_cls"), near).select("a", "b")


def _likely_wide(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the wide sketches leave."""

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array, size_x: pa.Array, size_y: pa.Array) -> pa.Array:
        out = []
        for p, q, size in zip(x, y, np.asarray(size_x) + np.asarray(size_y), strict=True):
            a, b = np.frombuffer(p.as_buffer(), np.uint8), np.frombuffer(q.as_buffer(), np.uint8)
            both = min(len(a), len(b))
            differ = int(np.bitwise_count(fold(a, both) ^ fold(b, both)).sum())
            out.append((100 + percent) * differ <= (100 - percent) * int(size))
        return pa.array(out, pa.bool_())

    one, two = (classes.select(F.col("cls").alias(f"{x}_cls"), F.col("wide").alias(f"wide_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
    p = pairs.join(two, F.col("b") == F.col("b_cls")).join(one, F.col("a") == F.col("a_cls"))
    return p.filter(near("wide_a", "wide_b", "size_a", "size_b")).select("a", "b")


def _verified(pairs: DataFrame, blobs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            inter = int((both[1:] == both[:-1]).sum())
            out.append(100 * inter >= percent * (len(both) - inter))
        return pa.array(out, pa.bool_())

    p = pairs.join(blobs.select(F.col("cls").alias("b"), F.col("blob").alias("blob_b")), "b")
    p = p.join(blobs.select(F.col("cls").alias("a"), F.col("blob").alias("blob_a")), "a")
    return p.filter(linked("blob_a", "blob_b")).select("a", "b")


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets. Elements of
    one set only do not matter; the others are columns of 0/1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = df[col] > 1
    owner, col = owner[use], np.unique(col[use], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    step = max(64, (4 << 20) // max(len(sets), 1))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        s, e = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[s:e], col[s:e] - lo] = 1
        out += m[left] @ m[right].T
    return out


def _compare_units(percent: int):
    """Links between different components among the members of each unit (a
    signature, or a pair of blocks of a large one). A pair is compared at the
    least signature that it shares; edges that close a cycle are left out."""

    def run(t: pa.Table) -> pa.Table:
        unit = np.asarray(t.column("unit"))
        order = np.argsort(unit, kind="stable")
        t = t.take(pa.array(order))
        unit = unit[order]
        sig, cls, comp, own, lo, hi = (np.asarray(t.column(c)) for c in ("sig", "cls", "c", "own", "lo", "hi"))
        blob, sigs = t.column("blob").combine_chunks(), t.column("sigs").combine_chunks()
        cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
        found: list[tuple[int, int]] = []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if (comp[s:e] == comp[s]).all():
                continue
            one = np.flatnonzero(own[s:e] == lo[s])
            two = one if lo[s] == hi[s] else np.flatnonzero(own[s:e] == hi[s])
            sets = [np.frombuffer(blob[i].as_buffer(), np.uint64) for i in range(s, e)]
            size = np.array([len(x) for x in sets], np.int64)
            ok = (comp[s:e][one, None] != comp[s:e][None, two]) & (cls[s:e][one, None] != cls[s:e][None, two])
            ok &= 100 * np.minimum(size[one, None], size[None, two]) >= percent * np.maximum(size[one, None], size[None, two])
            if not ok.any():
                continue
            # signatures before this one that both have: compared there
            earlier = [np.asarray(sigs[i].values) for i in range(s, e)]
            earlier = [x[x < sig[s]] for x in earlier]
            if any(len(x) for x in earlier):
                ok &= _intersections(earlier, one, two) == 0
            if not ok.any():
                continue
            inter = _intersections(sets, one, two)
            i, j = np.nonzero(ok & (100 * inter >= percent * (size[one, None] + size[None, two] - inter)))
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for x, y in zip((one[i] + s).tolist(), (two[j] + s).tolist(), strict=True):
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    up[max(p, q)] = min(p, q)
                    found.append((int(cls[x]), int(cls[y])))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], schema=_EDGE)

    return run


def _pairs(member: DataFrame, mixed: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a < b) across components of signatures with at most SMALL
    members, as far as their sketches leave them."""
    m = member.join(mixed, F.col("sig") == F.col("m_sig")).select("sig", "cls", "c")
    m = scratch.write(m.join(classes.drop("rep", "wide"), "cls"))
    one, two = (m.select(F.col("sig").alias(f"sig_{x}"), F.col("c").alias(f"c_{x}"), F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in SKETCH]) for x in "ab")
    near = (F.col("sig_a") == F.col("sig_b")) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _may_link(percent)
    return one.join(two, near).select("a", "b").distinct()


_MEMBER = pa.schema([("unit", pa.int64()), ("cls", pa.int64())])


def _likely_members(percent: int):
    """Members (unit, cls) that the sketches leave a partner in their unit.
    Sketches of different lengths are compared at the shorter one."""

    def run(t: pa.Table) -> pa.Table:
        unit = np.asarray(t.column("unit"))
        order = np.argsort(unit, kind="stable")
        t = t.take(pa.array(order))
        unit = unit[order]
        cls, comp, size, own, lo, hi = (np.asarray(t.column(c)) for c in ("cls", "c", "size", "own", "lo", "hi"))
        if "wide" in t.column_names:
            wide = t.column("wide").combine_chunks()
            sketch = [np.frombuffer(x.as_buffer(), np.uint8) for x in wide]
        else:
            sketch = list(np.column_stack([np.asarray(t.column(c)) for c in SKETCH]).view(np.uint8))
        length = np.array([len(x) for x in sketch], np.int64)
        keep = np.zeros(len(unit), bool)
        cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            one = own[s:e] == lo[s]
            two = own[s:e] == hi[s]
            for short in np.unique(length[s:e]).tolist():
                use = np.flatnonzero(length[s:e] >= short)
                words = np.array([fold(sketch[s + i], short) for i in use.tolist()]).view(np.uint64)
                left, right = np.flatnonzero(one[use]), np.flatnonzero(two[use])
                at = s + use
                for k in range(0, len(left), 256):
                    x = left[k : k + 256]
                    ok = (comp[at[x], None] != comp[at[right]]) & ((length[at[x], None] == short) | (length[at[right]] == short))
                    ok &= 100 * np.minimum(size[at[x], None], size[at[right]]) >= percent * np.maximum(size[at[x], None], size[at[right]])
                    i, j = np.nonzero(ok)
                    i, j = x[i], right[j]
                    step = max(1, (16 << 20) // short)
                    for z in range(0, len(i), step):
                        p, q = i[z : z + step], j[z : z + step]
                        differ = np.bitwise_count(words[p] ^ words[q]).sum(axis=1, dtype=np.int64)
                        near = (100 + percent) * differ <= (100 - percent) * (size[at[p]] + size[at[q]])
                        keep[at[p[near]]] = keep[at[q[near]]] = True
        return pa.table([unit[keep], cls[keep]], schema=_MEMBER)

    return run


def _units(m: DataFrame, block: int) -> DataFrame:
    """unit, own, lo, hi and the columns of members ``m`` (sig, cls, c, k) of a
    signature of up to ``block`` members in one unit. Those of a larger one are
    cut in blocks, first those of its commonest component, which need no
    comparison with each other, then the rest; a unit is a pair of blocks, one
    at least of the rest. So the component that a group of near copies already
    is grows a signature's rows in proportion only."""
    most = m.filter(F.col("k") > block).groupBy("sig", "c").agg(F.count("*").alias("n"))
    most = most.groupBy("sig").agg(F.max(F.struct("n", "c")).alias("most"))
    # by a derived key, so that the members of one signature can be split among tasks
    most = most.select(F.col("sig").alias("t_sig"), F.xxhash64("sig").alias("t_key"), F.col("most.n").alias("n"), F.col("most.c").alias("t_c"))
    u = m.withColumn("key", F.xxhash64("sig")).join(most, (F.col("sig") == F.col("t_sig")) & (F.col("key") == F.col("t_key")), "left").drop("t_sig", "t_key", "key")
    upto = lambda x: F.ceil(x / F.lit(block)).cast("int")
    u = u.withColumn("first", F.coalesce(upto(F.col("n")), F.lit(0))).withColumn("rest", upto(F.col("k") - F.coalesce("n", F.lit(0))))
    alike = F.coalesce(F.col("c") == F.col("t_c"), F.lit(False))
    h = F.xxhash64("cls")
    u = u.withColumn("own", F.when(alike, F.pmod(h, F.col("first"))).otherwise(F.col("first") + F.pmod(h, F.col("rest"))).cast("int"))
    u = u.withColumn("mate", F.explode(F.sequence(F.when(alike, F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)))
    u = u.withColumn("lo", F.least("own", "mate")).withColumn("hi", F.greatest("own", "mate"))
    return u.withColumn("unit", F.xxhash64("sig", "lo", "hi")).select("unit", *m.columns, "own", "lo", "hi")


def _across(member: DataFrame, mixed: DataFrame, sets: Sets, percent: int, scratch: Scratch, block: int = 1024) -> DataFrame:
    """Links (a, b) across components among the members of mixed signatures.
    No pair becomes a row: a set goes once to every unit it belongs to."""
    m = member.join(mixed, F.col("sig") == F.col("m_sig")).select("sig", "cls", "c", "k")
    m = scratch.write(m.join(sets.classes.select("cls", "size"), "cls"))
    lists = m.groupBy(F.col("cls").alias("l_cls")).agg(F.collect_list("sig").alias("sigs"))
    u = scratch.write(_units(m, block))

    def left(s: DataFrame, units: int) -> DataFrame:
        near = s.repartition(partitions_for(units, 16 << 20), "unit").mapInArrow(whole_partition(_likely_members(percent), _MEMBER), "unit long, cls long")
        near = near.select(F.col("unit").alias("l_unit"), F.col("cls").alias("l_cls"))
        return scratch.write(u.join(near, (F.col("unit") == F.col("l_unit")) & (F.col("cls") == F.col("l_cls")), "left_semi"))

    # sketches first, then wide ones: the sets of members without a likely partner do not travel
    known = sets.classes.withColumnRenamed("cls", "s_cls")
    u = left(u.drop("sig").join(known.select("s_cls", *SKETCH), F.col("cls") == F.col("s_cls")).drop("s_cls"), 100 * u.count())
    u = left(u.drop("sig").join(known.select("s_cls", "wide"), F.col("cls") == F.col("s_cls")).drop("s_cls"), u.agg(F.sum("size")).first()[0] or 0)
    elements = u.agg(F.sum("size")).first()[0] or 0
    used = u.select("cls").distinct()
    sets.want(used)
    blobs = sets.all().join(used, "cls", "left_semi").withColumnRenamed("cls", "b_cls")
    u = u.join(lists, F.col("cls") == F.col("l_cls")).drop("l_cls").join(blobs, F.col("cls") == F.col("b_cls")).drop("b_cls")
    tasks = partitions_for(8 * elements, 16 << 20)
    edges = u.repartition(tasks, "unit").mapInArrow(whole_partition(_compare_units(percent), _EDGE), "a long, b long")
    return scratch.write(edges, batch_rows=2000)


def _sizes_agree(percent: int):
    return 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")


def _mixed(shared: DataFrame, comp: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (sig, cls, c) by component, and the signatures (m_sig, k) whose
    members are in different ones."""
    member = shared.join(comp, F.col("cls") == F.col("v"), "left").select("sig", "cls", F.coalesce("component", "cls").alias("c"))
    member = scratch.write(member)
    mixed = member.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).filter("lo <> hi")
    return member, scratch.write(mixed.select(F.col("sig").alias("m_sig"), "k"))


def jaccard_components(
    docs: DataFrame, scratch: Scratch, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text",
    bytes_per_part: int = 20 << 20,
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    scratch.settings = scratch.settings | SMALL_JOINS
    sets = scratch.write(document_sets(docs, n, doc_id, text), batch_rows=2000)
    largest = sets.agg(F.max("size")).first()[0] or 0
    bands = Bands(percent, largest)
    parts = partitions_for(text_bytes(docs, text), bytes_per_part)
    blocks = _signature_blocks(docs.filter(F.col(doc_id).isNotNull()), n, text, bands, parts)
    shared = scratch.write(blocks.repartition(parts, "part").mapInArrow(whole_partition(_shared_signatures, _SHARED), "sig long, cls long"), batch_rows=2000)
    classes = sets.filter("size > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", *SKETCH, "wide")])
    classes = scratch.write(classes)
    known = Sets(docs, classes, n, doc_id, text, percent, scratch)

    # round 1: every member of a signature against its least member
    hub = shared.groupBy("sig").agg(F.min("cls").alias("a"))
    hub = hub.select(F.col("sig").alias("h_sig"), "a", F.xxhash64("sig").alias("h_key"))
    star = shared.withColumn("key", F.xxhash64("sig")).join(hub, (F.col("sig") == F.col("h_sig")) & (F.col("key") == F.col("h_key")))
    star = scratch.write(_likely(star.filter("cls <> a").select("a", F.col("cls").alias("b")).distinct(), classes, percent))
    links = known.links(star)
    comp = scratch.write(connected_components(links, scratch))
    member, mixed = _mixed(shared, comp, scratch)

    # round 2: signatures whose members are in different components still
    few = _pairs(member, mixed.filter(F.col("k") <= SMALL), classes, percent, scratch)
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few = scratch.write(few.join(done, ["a", "b"], "left_anti"))
    # the links of round 1 by their components: a row a class, not a link
    links = comp.select(F.col("v").alias("a"), F.col("component").alias("b")).union(known.links(few)).union(_across(member, mixed.filter(F.col("k") > SMALL), known, percent, scratch))

    # classes -> least document: rows that repeat an id tie their classes together
    a, b = (classes.select(F.col("cls").alias(x), F.col("rep").alias(f"r_{x}")) for x in "ab")
    edges = links.join(a, "a").join(b, "b").select(F.col("r_a").alias("x"), F.col("r_b").alias("y"))
    own = sets.filter("size > 0 AND doc_id IS NOT NULL").select("doc_id", "cls").distinct()
    multi = own.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    rep = classes.select("cls", "rep")
    tied = own.join(multi, "doc_id", "left_semi").join(rep, "cls").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    final = connected_components(edges.union(tied).filter("x <> y"), scratch)
    place = rep.join(final, F.col("rep") == F.col("v"), "left").select(F.col("cls").alias("p_cls"), F.coalesce("component", "rep").alias("component_id"))
    place = scratch.write(place)
    known.drop()
    scratch.drop(shared, classes, star, comp, member, mixed, few)
    out = sets.withColumn("key", F.xxhash64("cls")).join(
        place.withColumn("p_key", F.xxhash64("p_cls")), (F.col("cls") == F.col("p_cls")) & (F.col("key") == F.col("p_key")) & (F.col("size") > 0), "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
