"""Repeated passages by a distributed difference-cover suffix array.

Two suffixes with an equal prefix of ``length`` bytes hold the same anchor (the
least-hashed ``gram``-byte string of that prefix) at the same place. Anchors
therefore deal suffixes out to tasks: equal prefixes always meet, in any
distribution of the data, and an anchor that only one document has rules its
prefixes out before any text moves. For anchors of several documents the bytes
around them (contexts) meet by anchor; contexts that are equal as a whole are
one name, with the least document that has it. Where an anchor has different
contexts, their suffixes are sorted by the difference-cover algorithm (sample
suffixes at places 1, 2 mod 3, sort their triples, recurse on the names, merge
the remaining suffixes), and neighbours that agree on ``length`` bytes share
the least document of all.

Hot passages: anchors and contexts are reduced to least and greatest document
map-side before each shuffle, and verdicts go back to occurrences in a join
that adaptive execution can split.

Defined cases: NULL text is empty; texts shorter than ``length`` keep all
bytes; rows with a NULL id neither remove nor lose anything; rows with equal
ids do not remove each other's bytes; matches never cross texts; repeated rows
come back each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._shared import Scratch, partitions_for, text_bytes, whole_partition
from ledgerlens.llm._words import mix, range_hashes, text_chunks

_U = np.uint64


# -- suffix sorting --------------------------------------------------------


def _order(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first one leading) and dense names from 1."""
    width = sum(int(k.max()).bit_length() if len(k) else 0 for k in keys)
    if width <= 63:
        packed = np.zeros(len(keys[0]), np.int64)
        for k in keys:
            packed = (packed << (int(k.max()).bit_length() if len(k) else 0)) | k
        order = np.argsort(packed)
        new = np.r_[True, packed[order][1:] != packed[order][:-1]] if len(order) else np.zeros(0, bool)
    else:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return order, names


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` (integers >= 1) by difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    x = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, names = _order(x[sample], x[sample + 1], x[sample + 2])
    if names.max(initial=0) < len(sample):
        order = suffix_order(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sa12 = sample[order]
    sa12 = sa12[sa12 < n]
    zero = np.arange(0, n, 3)
    o, _ = _order(x[zero], rank[zero + 1])
    sa0 = zero[o]
    # merge: for each remaining suffix, the number of sample suffixes before it
    top = int(rank.max()) + 1
    sym = int(x.max()) + 1
    s1, s2 = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    before = np.searchsorted(x[s1] * top + rank[s1 + 1], x[sa0] * top + rank[sa0 + 1])
    if sym * sym * top < 1 << 62:
        k2, k0 = (x[s2] * sym + x[s2 + 1]) * top + rank[s2 + 2], (x[sa0] * sym + x[sa0 + 1]) * top + rank[sa0 + 2]
    else:  # dense names of the pairs keep the keys within 64 bits
        both = np.concatenate([s2, sa0])
        _, pair = _order(x[both], x[both + 1])
        k = pair * top + rank[both + 2]
        k2, k0 = k[: len(s2)], k[len(s2) :]
    before = before + np.searchsorted(k2, k0)
    out = np.empty(n, np.int64)
    at = before + np.arange(len(sa0))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = sa0
    out[free] = sa12
    return out


def _loads(buf: np.ndarray, kind: str) -> np.ndarray:
    """Unaligned little-endian integers at every byte."""
    size = np.dtype(kind).itemsize
    return np.ndarray((len(buf) - size + 1,), kind, buf, strides=(1,))


def least_of_equal_prefixes(texts: list[bytes], value: np.ndarray, length: int) -> list[np.ndarray]:
    """For every prefix start of every text, the least ``value`` among the
    texts that hold the same ``length`` bytes anywhere."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join(texts) + b"\0" + b"\0" * length, np.uint8)
    symbols = raw[: base[-1]].astype(np.int64) + 2
    symbols[base[1:] - 1] = 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(base[-1]) - base[owner]
    start = place + length <= sizes[owner]
    sa = suffix_order(symbols)
    sa = sa[start[sa]]
    same = np.ones(max(len(sa) - 1, 0), bool)
    wide, byte = _loads(raw, "<u8"), raw
    for k in range(0, length - length % 8, 8):
        same &= wide[sa[1:] + k] == wide[sa[:-1] + k]
    for k in range(length - length % 8, length):
        same &= byte[sa[1:] + k] == byte[sa[:-1] + k]
    out = np.full(base[-1], np.iinfo(np.int64).max)
    if len(sa):
        heads = np.flatnonzero(np.r_[True, ~same])
        least = np.minimum.reduceat(value[owner[sa]], heads)
        out[sa] = np.repeat(least, np.diff(np.r_[heads, len(sa)]))
    return [out[base[i] : base[i] + max(0, sizes[i] - length + 1)] for i in range(len(texts))]


# -- anchors ---------------------------------------------------------------


def anchor_runs(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first prefix start, last one, anchor hash, place of the anchor)
    for every run of neighbouring ``length``-byte strings of a document with one
    anchor."""
    n, w = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none
    wide = _loads(buf, "<u8")
    size = n - gram + 1
    h = wide[:size] * _U(0x9E3779B97F4A7C15)
    at = 8
    while at < gram:
        at = min(at, gram - 8)
        h = mix(h + wide[at : at + size])
        h *= _U(0xD6E8FEB86659FD93)
        at += 8
    h = mix(h)
    bits = _U(_PLACE_BITS)  # the same for every piece, so ties end alike
    key = ((h >> bits) << bits) | np.arange(size, dtype=np.uint64)
    span, m = 1, key
    while 2 * span <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    anchor = (m & ((_U(1) << bits) - _U(1))).astype(np.int64)
    del key, m
    start = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(start)]
    ok = start + length <= offs[doc + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & ok)
    if not len(first):
        return none, none, none, none.astype(np.uint64), none
    ends = np.flatnonzero(ok & np.r_[new[1:] | ~ok[1:], True])
    return doc[first], first, ends, h[anchor[first]], anchor[first]


def run_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run's context, and 16-bit hashes of the bytes left and right
    of its anchor, half of what a prefix holds besides it; 0 where no prefix of
    the run holds them all. Any prefix holds one of the two sides, so prefixes
    that are equal agree in their anchors and in the hash of a side that both
    runs have."""
    half, n = (length - gram) // 2, len(first)
    left = anchor - half >= first
    right = anchor + gram + half <= last + length
    lo = np.concatenate([first, np.where(left, anchor - half, 0), np.where(right, anchor + gram, 0)])
    hi = np.concatenate([last + length, np.where(left, anchor, 0), np.where(right, anchor + gram + half, 0)])
    h = range_hashes(buf, lo, hi)
    sides = [np.where(held, x % _U(65535) + _U(1), _U(0)).astype(np.uint16) for held, x in ((left, h[n : 2 * n]), (right, h[2 * n :]))]
    return h[:n], *sides


PIECE = 1 << 18  # bytes of text looked at at once: a longer text comes in pieces that overlap
CHUNK = 2 << 20  # bytes of text whose anchors leave together
_PLACE_BITS = 20


def _pieces(col: pa.Array, length: int):
    """(first row, first byte of its text, bytes, offsets) of whole short texts
    or of a piece of a long one; every prefix start is in one piece."""
    for lo, _, buf, offs in text_chunks(col, PIECE):
        if len(buf) <= 2 * PIECE:
            yield lo, 0, buf, offs
            continue
        for at in range(0, len(buf) - length + 1, PIECE):
            part = buf[at : at + PIECE + length - 1]
            yield lo, at, part, np.array([0, len(part)])


_M48 = _U((1 << 48) - 1)


def _split48(x: np.ndarray) -> bytes:
    return (x & _U(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((x >> _U(32)) & _U(0xFFFF)).astype(np.uint16).tobytes()


def _join48(b) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, np.uint32, n).astype(np.uint64) | (np.frombuffer(b, np.uint16, n, 4 * n).astype(np.uint64) << _U(32))


def _anchor_blocks(docs: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """A chunk's anchors as parallel arrays: 48 bits of the anchor's hash, 48
    bits of its context's, start and number of the prefixes of the run, and the
    hashes of the anchor's two sides."""
    columns = ("ids", "keys", "hash", "name", "place", "runs", "sides")
    schema = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in columns]])

    def leave(ids, keys, found):
        doc, start, runs, h, name, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        # anchors are the least hashes around, so mostly small: hashed again, they spread over all parts
        part = ((mix(h) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        order = np.argsort((part << 32) | np.arange(len(part)))
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(cut[1:] > cut[:-1]):
            o = order[cut[p] : cut[p + 1]]
            d, row = np.unique(doc[o], return_inverse=True)
            # which document: as counts, since entries are in document order
            place = np.concatenate([np.bincount(row), start[o]]).astype(np.uint32)
            split = (place & 0xFFFF).astype(np.uint16).tobytes() + (place >> 16).astype(np.uint16).tobytes()
            rows.append((int(p), ids[d].tobytes(), keys[d].tobytes(), _split48(h[o]), _split48(name[o]), split, runs[o].tobytes(), left[o].tobytes() + right[o].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        for b in batches:
            ids, keys = np.asarray(b.column(0)), np.asarray(b.column(1))
            found, size = [], 0
            for lo, at, buf, offs in _pieces(b.column(2), length):
                doc, first, last, h, anchor = anchor_runs(buf, offs, length, gram)
                size += len(buf)
                if len(doc):
                    hashes = run_hashes(buf, first, last, anchor, length, gram)
                    found.append((doc + lo, first - offs[doc] + at, (last - first + 1).astype(np.uint8), h, *hashes))
                if found and size >= CHUNK:
                    yield leave(ids, keys, found)
                    found, size = [], 0
            if found:
                yield leave(ids, keys, found)

    return docs.select("id", "key", "t").mapInArrow(run, "part int, ids binary, keys binary, hash binary, name binary, place binary, runs binary, sides binary")


_PLACES = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("runs", pa.int32()), ("anchor", pa.int64()), ("name", pa.int64())])
_PLACES_DDL = "id long, key long, at int, runs int, anchor long, name long"


def _several(group: np.ndarray, side: np.ndarray, d: np.ndarray) -> np.ndarray:
    """True where documents of two ids or more have the group's side."""
    g = (group << 16) | side
    order = np.argsort(g)
    g = g[order]
    heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    several = np.minimum.reduceat(d[order], heads) != np.maximum.reduceat(d[order], heads)
    out = np.empty(len(d), bool)
    out[order] = np.repeat(several, np.diff(np.r_[heads, len(g)]))
    return out


def _shared_places(t: pa.Table) -> pa.Table:
    """Of anchors in documents of two ids or more: runs that go as a whole (all
    contexts are equal and a smaller id has one; without anchor) and runs to be
    looked at, where another document has the same bytes on a side."""
    part = np.asarray(t.column("part"))
    out = []
    for p in np.unique(part):
        hs, names, docs, owners, starts, runs, lefts, rights = [], [], [], [], [], [], [], []
        for i in map(int, np.flatnonzero(part == p)):
            d = np.frombuffer(t.column("ids")[i].as_buffer(), np.int64)
            split = t.column("place")[i].as_buffer()
            n = len(split) // 4
            place = np.frombuffer(split, np.uint16, n).astype(np.uint32) | (np.frombuffer(split, np.uint16, n, 2 * n).astype(np.uint32) << np.uint32(16))
            per = place[: len(d)].astype(np.int64)
            hs.append(_join48(t.column("hash")[i].as_buffer()))
            names.append(_join48(t.column("name")[i].as_buffer()))
            owners.append(np.repeat(np.arange(len(d), dtype=np.int32) + sum(len(x) for x in docs[::2]), per))
            docs += [d, np.frombuffer(t.column("keys")[i].as_buffer(), np.int64)]
            starts.append(place[len(d) :])
            runs.append(np.frombuffer(t.column("runs")[i].as_buffer(), np.uint8))
            sides = np.frombuffer(t.column("sides")[i].as_buffer(), np.uint16)
            lefts.append(sides[: len(sides) // 2])
            rights.append(sides[len(sides) // 2 :])
        ids, keys = np.concatenate(docs[::2]), np.concatenate(docs[1::2])
        h, name, owner, start, run, left, right = (np.concatenate(x) for x in (hs, names, owners, starts, runs, lefts, rights))
        del hs, names, owners, starts, runs, lefts, rights
        order = np.argsort(h)
        g = h[order]
        heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[heads, len(g)])
        del g
        # anchors of a single occurrence go first: most of them
        order = order[np.repeat(size > 1, size)]
        size = size[size > 1]
        if not len(size):
            continue
        heads = np.concatenate([[0], np.cumsum(size)[:-1]])
        h, name, owner, start, run, left, right = (x[order] for x in (h, name, owner, start, run, left, right))
        d = ids[owner]
        least = np.minimum.reduceat(d, heads)
        both = least != np.maximum.reduceat(d, heads)
        one = np.minimum.reduceat(name, heads) == np.maximum.reduceat(name, heads)
        whole = np.repeat(both & one, size) & (d > np.repeat(least, size))
        unsure = np.repeat(both & ~one, size)
        look = np.flatnonzero(unsure)
        if len(look):
            group = np.repeat(np.arange(len(size)), size)[look]
            alike = [(side[look] > 0) & _several(group, side[look], d[look]) for side in (left, right)]
            unsure[look] = alike[0] | alike[1]
        use = np.flatnonzero(whole | unsure)
        if not len(use):
            continue
        use = use[np.argsort((owner[use].astype(np.int64) << 32) | start[use])]
        own, sure = owner[use], ~unsure[use]
        anchor, context = (pa.array(x[use].view(np.int64), mask=sure) for x in (h, name))
        out.append(pa.table([ids[own], keys[own], start[use].astype(np.int32), run[use].astype(np.int32), anchor, context], schema=_PLACES))
    return pa.concat_tables(out) if out else _PLACES.empty_table()


_SHARES = 16
SORT_BYTES = 1 << 20  # sorting takes some 100 times as many bytes of memory
_VERDICT = pa.schema([("anchor", pa.int64()), ("name", pa.int64()), ("runs", pa.binary()), ("least", pa.binary())])


def _verdicts(length: int):
    """Per context: runs of prefix starts and the least document of each, where
    that removes something from a document that has the context."""

    def run(t: pa.Table) -> pa.Table:
        anchor = np.asarray(t.column("anchor"))
        t = t.take(pa.array(np.argsort(anchor, kind="stable")))
        anchor, name, ids, top = (np.asarray(t.column(c)) for c in ("anchor", "name", "id", "top"))
        ctx = t.column("ctx").combine_chunks()
        size = np.asarray(pa.compute.binary_length(ctx)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        many = np.repeat(np.diff(np.r_[heads, len(anchor)]) > 1, np.diff(np.r_[heads, len(anchor)]))
        found = [(i, np.array([size[i] - length + 1], np.uint32).tobytes(), ids[i].tobytes()) for i in np.flatnonzero(~many & (ids < top)).tolist()]
        rows = np.flatnonzero(many)
        # groups of anchors are independent: about SORT_BYTES of text are sorted at a time
        cut = np.searchsorted(np.cumsum(size[rows]), np.arange(SORT_BYTES, int(size[rows].sum()) + SORT_BYTES, SORT_BYTES))
        lo = 0
        for hi in np.unique(np.r_[cut, len(rows)]):
            hi = int(hi)
            while 0 < hi < len(rows) and anchor[rows[hi]] == anchor[rows[hi - 1]]:
                hi += 1
            if hi <= lo:
                continue
            group = rows[lo:hi]
            for i, v in zip(group.tolist(), least_of_equal_prefixes(ctx.take(pa.array(group)).to_pylist(), ids[group], length), strict=True):
                if v.min() < top[i]:
                    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                    found.append((i, np.diff(np.r_[at, len(v)]).astype(np.uint32).tobytes(), v[at].astype(np.int64).tobytes()))
            lo = hi
        place, runs, least = zip(*found, strict=True) if found else ([], [], [])
        place = np.array(place, np.int64)
        return pa.table([anchor[place], name[place], pa.array(runs, pa.binary()), pa.array(least, pa.binary())], schema=_VERDICT)

    return run


def _ranges(length: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches):
        for b in batches:
            ids, keys, at = (np.asarray(b.column(k)) for k in range(3))
            counts = np.asarray(pa.compute.binary_length(b.column(3))).astype(np.int64) // 4
            row = np.repeat(np.arange(b.num_rows), counts)
            n = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).astype(np.int64)
            v = np.frombuffer(b"".join(b.column(4).to_pylist()), np.int64)
            end = np.cumsum(n)
            before = np.r_[0, end][np.r_[0, np.cumsum(counts)[:-1]]] if len(counts) else end
            hi = at[row] + end - before[row]
            hit = v < ids[row]
            row = row[hit]
            cols = [ids[row], keys[row], hi[hit] - n[hit], hi[hit] - 1 + length]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _strip():
    """Union of the ranges of each text, and what is left of it."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            ends = []
            for k in (3, 4):
                col = b.column(k)
                values, offs = np.asarray(col.flatten()), np.r_[0, np.cumsum(np.asarray(pa.compute.list_value_length(col)))]
                ends.append((values, offs))
            (los, offs), (his, _) = ends
            for i in range(b.num_rows):
                raw = np.frombuffer(b.column(2)[i].as_py().encode(), np.uint8)
                lo, hi = los[offs[i] : offs[i + 1]], his[offs[i] : offs[i + 1]]
                step = np.bincount(lo, minlength=len(raw) + 1) - np.bincount(hi, minlength=len(raw) + 1)
                g = np.cumsum(step[:-1]) > 0
                spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
                rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), int(g.sum()), spans, hashlib.sha256(raw[~g].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([],) * 5, schema, strict=True)], schema=schema)

    return run


def _one_of_each(known: DataFrame, scratch: Scratch) -> DataFrame:
    """``known`` (id, t, key) with one row of each id and text. Only rows that do
    repeat are shuffled with their texts, dealt by a share of the row besides
    the id, so that copies of one row are many tasks' work, and combined map-side."""
    twice = known.groupBy("id", "key").agg(F.count("*").alias("n")).filter("n > 1")
    twice = scratch.write(twice.select(F.col("id").alias("t_id"), F.col("key").alias("t_key"))).withColumn("t_share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
    if twice.isEmpty():
        return known
    shared = known.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(_SHARES)).cast("int"))
    same = (F.col("id") == F.col("t_id")) & (F.col("key") == F.col("t_key")) & (F.col("share") == F.col("t_share"))
    again = shared.join(twice, same, "left_semi").groupBy("id", "key").agg(F.min("t").alias("t"))
    once = shared.join(twice, same, "left_anti")
    return scratch.write(once.select("id", "t", "key").unionByName(again), batch_rows=2000)


def repeated_passages(
    docs: DataFrame, scratch: Scratch, length: int = 50, gram: int = 20, doc_id: str = "doc_id", text: str = "text",
    bytes_per_part: int = 10 << 20,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``."""
    if not 8 <= gram <= length < gram + 255:
        raise ValueError("gram must be at least 8, at most length, and length less than gram + 255")
    # a text is known by its id and a hash, since ids may repeat
    d = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("key", F.xxhash64("t"))
    known = _one_of_each(d.filter(F.col("id").isNotNull() & (F.octet_length("t") >= length)), scratch)
    parts = partitions_for(text_bytes(docs, text), bytes_per_part)
    places = _anchor_blocks(known, length, gram, parts).repartitionById(parts, "part")
    places = scratch.write(places.mapInArrow(whole_partition(_shared_places, _PLACES), _PLACES_DDL))

    # texts are shuffled by (id, key) once: both joins read one exchange
    unsure = places.filter("anchor IS NOT NULL")
    look = unsure.select(F.col("id").alias("p_id"), F.col("key").alias("p_key"), "at", "runs", "anchor", "name")
    look = known.join(look, (F.col("id") == F.col("p_id")) & (F.col("key") == F.col("p_key")))
    context = F.substring(F.col("t").cast("binary"), F.col("at") + 1, F.col("runs") + F.lit(length - 1)).alias("ctx")
    names = look.select("anchor", "name", context, "id").groupBy("anchor", "name", "ctx").agg(F.min("id").alias("id"), F.max("id").alias("top"))
    verdicts = names.repartition(parts, "anchor").mapInArrow(whole_partition(_verdicts(length), _VERDICT), "anchor long, name long, runs binary, least binary")
    verdicts = verdicts.select(F.col("anchor").alias("v_anchor"), F.col("name").alias("v_name"), F.col("runs").alias("v_runs"), "least")
    hits = unsure.join(verdicts, (F.col("anchor") == F.col("v_anchor")) & (F.col("name") == F.col("v_name")))
    ranges = hits.select("id", "key", "at", "v_runs", "least").mapInArrow(_ranges(length), "id long, key long, lo int, hi int")
    whole = places.filter("anchor IS NULL").select("id", "key", F.col("at").alias("lo"), (F.col("at") + F.col("runs") + F.lit(length - 1)).alias("hi"))
    marks = whole.union(ranges).groupBy("id", "key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    marks = marks.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"), "lo", "hi")
    cut = known.join(marks, (F.col("id") == F.col("r_id")) & (F.col("key") == F.col("r_key"))).select("id", "key", "t", "lo", "hi")
    cut = cut.mapInArrow(_strip(), "id long, key long, n_removed long, n_spans long, kept string").distinct()
    cut = scratch.write(cut, batch_rows=2000).select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), "n_removed", "n_spans", "kept")
    all_ = d.select("id", "key", F.octet_length("t").cast("bigint").alias("n_bytes"), F.sha2(F.col("t").cast("binary"), 256).alias("whole"))
    out = all_.join(cut, (F.col("id") == F.col("c_id")) & (F.col("key") == F.col("c_key")), "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
