"""Findings of round 3, on rows made here."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from ledgerlens.llm import lm_scoring as lm
from ledgerlens.llm import shingle_join as sj
from ledgerlens.llm import suffix_dedup as sd
from ledgerlens.llm._graph import connected_components
from ledgerlens.llm._shared import Scratch, whole_partition


def test_units_grow_with_a_group_not_with_its_square(spark):
    """Members that already are one component meet the rest, not each other."""
    rows = [(1, i, 0 if i < 570 else i, 600) for i in range(600)] + [(2, i, i, 40) for i in range(40)] + [(3, i, i % 2, 90) for i in range(90)]
    u = sj._units(spark.createDataFrame(rows, "sig long, cls long, c long, k long"), 50).collect()
    per_unit = {}
    for r in u:
        per_unit.setdefault((r.sig, r.unit), []).append(r)
    met = {}
    for (sig, _), m in per_unit.items():
        lo, hi = m[0].lo, m[0].hi
        one, two = [r for r in m if r.own == lo], [r for r in m if r.own == hi]
        for pair in {tuple(sorted((x.cls, y.cls))) for x in one for y in two if x.c != y.c and x.cls != y.cls}:
            met[sig, pair] = met.get((sig, pair), 0) + 1
    want = {(s, (a, b)) for s, a, c, _ in rows for t, b, d, _ in rows if s == t and a < b and c != d}
    assert set(met) == want and set(met.values()) == {1}
    # 570 once, 30 against twelve blocks and their own; every block with every other would be 600 * 12
    assert sum(r.sig == 1 for r in u) == 570 + 30 * 13


def test_wide_sketches_rule_out_no_linked_pair():
    rnd = random.Random(3)
    for size in (1, 40, 700, 3000):
        a = np.array(sorted(rnd.sample(range(1 << 60), size)), np.uint64)
        for change in (0, size // 10, size // 2):
            b = np.unique(np.r_[a[change:], np.array(rnd.sample(range(1 << 60), change), np.uint64)])
            x, y = (np.frombuffer(sj.wide_sketch(z), np.uint8) for z in (a, b))
            n = min(len(x), len(y))
            differ = int(np.bitwise_count(sj.fold(x, n) ^ sj.fold(y, n)).sum())
            assert differ <= len(np.setxor1d(a, b))
            assert differ >= len(np.setxor1d(a, b)) // 4


def test_long_unlinked_texts_are_ruled_out_before_their_sets_are_made(spark, monkeypatch):
    """Long texts that share passages but are no near copies: the short sketch
    is full and tells nothing, the wide one spares their sets."""
    rnd = random.Random(5)
    shared = [f"s{i}" for i in range(900)]
    rows = [(i, " ".join(shared + [f"{i}x{rnd.random()}" for _ in range(900)])) for i in range(12)]
    near = rows[0][1].split()
    near[5] = "other"
    rows.append((100, " ".join(near)))
    made = []
    real = sj._blobs
    monkeypatch.setattr(sj, "_blobs", lambda docs, reps, *a: made.append({r.rep for r in reps.collect()}) or real(docs, reps, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sj.jaccard_components(docs, Scratch(spark, "t"), 5, 80).collect()}
    assert got == brute.jaccard(rows, 5, 80)
    assert set().union(*made) == {0, 100}


def test_shared_places_do_not_grow_with_the_number_of_parts(spark):
    """A row for every run, however many tasks the anchors are dealt to."""
    rnd = random.Random(7)
    base = "".join(rnd.choices("abcdefgh ", k=3000))
    rows = [(i, i, base[i * 7 :] + "".join(rnd.choices("xyz ", k=200))) for i in range(30)]
    known = spark.createDataFrame(rows, "id long, key long, t string").repartition(4, "id")
    counts = []
    for parts in (2, 40):
        blocks = sd._anchor_blocks(known, 50, 20, parts).repartitionById(parts, "part")
        counts.append(blocks.mapInArrow(whole_partition(sd._shared_places, sd._PLACES), sd._PLACES_DDL).count())
    assert counts[0] == counts[1] > 1000


def test_passages_whose_anchor_also_stands_elsewhere(spark):
    """An anchor string amid other bytes is not looked at again; one with equal
    bytes on either side only is, and nothing of a shared passage is lost."""
    rnd = random.Random(11)
    letters = lambda k: "".join(rnd.choices("ab", k=k))
    anchors = [letters(24) for _ in range(6)]
    rows = [(i, "".join(letters(rnd.randint(0, 40)) + rnd.choice(anchors) for _ in range(12))) for i in range(40)]
    whole = letters(90)
    for i in range(0, 40, 3):
        at, cut = rnd.randint(0, 60), rnd.randint(0, 40)
        rows[i] = (i, rows[i][1][:at] + whole[cut : cut + rnd.randint(49, 52)] + rows[i][1][at:])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = {}
    for i, t in rows:
        gone = {k + x for k in range(len(t) - 49) if first[t[k : k + 50]] < i for x in range(50)}
        want[i] = (len(gone), sum(x - 1 not in gone for x in gone))
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in sd.repeated_passages(docs, Scratch(spark, "t")).collect()}
    assert got == want and any(n for n, _ in want.values())


def _on_disk(*folders):
    return sum(os.path.getsize(os.path.join(d, f)) for folder in folders for d, _, files in os.walk(folder) for f in files)


def test_scoring_moves_few_bytes_a_word(spark):
    """As rows of n-grams, shuffles and stored tables took over ten times the text."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "t")
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    before = _on_disk(*folders)
    got = sorted(lm.stupid_backoff(docs, scratch).select("n_tokens", "n_backoff", "n_unigram").collect())
    assert got == sorted(x[:3] for x in brute.backoff_scores(texts, 0.4, 3))
    assert _on_disk(*folders, scratch.path.removeprefix("file:")) - before < 4 * sum(map(len, texts))


def test_counts_of_copies_long_texts_and_wordless_rows(spark):
    rng = random.Random(22)
    texts = [None, "", " \n", "a", "a b", "b", *["the same text again and again"] * 50, " ".join(rng.choices("abc", k=20_000)), "a a a a"]
    docs = spark.createDataFrame([(k % 7 or None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for order in (2, 3):
        want = brute.backoff_scores(texts, 0.4, order)
        got = lm.stupid_backoff(docs, Scratch(spark, "t"), order=order, chunk_bytes=100, bytes_per_part=3000).collect()
        key = lambda x: (*x[:3], round(x[3], 6))
        assert sorted(key(r[1:5]) for r in got) == sorted(map(key, want))
        assert all((r.mean_score is None) == (r.n_tokens == 0) for r in got)


def test_packed_numbers_come_back():
    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (lm.unpack(lm.pack(x), len(x)) == x).all()


def test_changed_texts_are_not_scored_with_the_answers_of_others():
    def chunk(text):
        return next(iter(lm._compress([pa.RecordBatch.from_pylist([{"chunk": 0, "doc_id": 1, "t": text}])])))

    answers = lm._answer(lm._ask(8)(pa.Table.from_batches([chunk("a b c")])))
    assert len(lm._score(2, 0.4, 8)(pa.Table.from_batches([chunk("a b c")]), answers)) == 1
    with pytest.raises(ValueError, match="changed"):
        lm._score(2, 0.4, 8)(pa.Table.from_batches([chunk("a b d")]), answers)


class _Counted(Scratch):
    """A scratch folder that counts its tables."""

    def __init__(self, spark):
        super().__init__(spark, "components")
        self.writes = 0

    def write(self, df, **kw):
        self.writes += 1
        return super().write(df, **kw)


def test_components_stop_when_the_edges_are_stars(spark):
    """No round of joins shows that nothing changes: stars take none."""
    stars = [(10 * k, 10 * k + i) for k in range(1, 5) for i in range(1, 6)]
    scratch = _Counted(spark)
    got = {(r.v, r.component) for r in connected_components(spark.createDataFrame(stars, "a long, b long"), scratch).collect()}
    assert got == {(b, a) for a, b in stars} | {(a, a) for a, _ in stars}
    assert scratch.writes == 1


def test_components_of_any_graph(spark):
    rnd = random.Random(11)
    edges = [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(280)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000 + i, 2100) for i in range(60)] + edges[:20] + [(5, 5), (None, 3), (4, None), (9000, 9000)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    rows = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "graph")).collect()
    assert sorted((r.v, r.component) for r in rows) == sorted((x, root(x)) for x in list(up))


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), Scratch(spark, "graph")).count() == 0


def test_documents_are_joined_by_a_row_a_class(spark, monkeypatch):
    """The last components are made from those of round 1, not from its links
    (a class has one to the hub of every signature) again."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + ["x" + str(i)] + base[i + 1 :])) for i in range(40)] + [(100 + i, f"alone {i} " * 9) for i in range(9)]
    seen = []
    real = sj.connected_components
    monkeypatch.setattr(sj, "connected_components", lambda edges, *a: seen.append(edges.count()) or real(edges, *a))
    found = sj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "near"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: 0 if i < 40 else i for i, _ in rows}
    assert seen[0] > 40 >= seen[1]


def test_small_joins_are_not_sorted(spark, monkeypatch):
    """The setting holds while a table is made, and only then."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before, seen = spark.conf.get(name), set()
    real = Scratch.write

    def write(self, df, **kw):
        seen.add(self.settings.get(name))
        return real(self, df, **kw)

    monkeypatch.setattr(Scratch, "write", write)
    docs = spark.createDataFrame([(i, f"a b c d {i % 3} f") for i in range(9)], "doc_id long, text string")
    scratch = Scratch(spark, "joins")
    assert {r.component_id for r in sj.jaccard_components(docs, scratch).collect()} == {0, 1, 2}
    assert seen == {str(16 << 20)} and spark.conf.get(name) == before
    scratch.settings = {"ledgerlens.test": "1"}
    real(scratch, spark.range(3))
    assert spark.conf.get("ledgerlens.test", None) is None
