"""The corpus pipeline, stage by stage against plain versions."""

from collections import Counter

import brute

import corpus_pipeline as cp
from ledgerlens.llm._shared import Scratch
from ledgerlens.llm.pii_bootstrap import learn_patterns

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [f.__name__ for _, f in cp.STAGES] == ["quality_stage", "near_duplicate_stage", "pii_stage", "mixing_stage", "packing_stage"]
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns

    kept = scratch.write(cp.quality_stage(spark, docs, SF))
    assert kept.columns == cols
    failed = {r.doc_id for r in docs.collect() if brute.base_quality(r.text)[-1]}
    ids = {r.doc_id for r in kept.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not ids & failed and all(i in ids or i in failed for i, v in labels.items() if v == 1)

    near = scratch.write(cp.near_duplicate_stage(spark, kept, SF))
    assert near.columns == cols
    want = brute.jaccard([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert {r.doc_id for r in near.collect()} == {d for d, (_, c) in want.items() if d == c}

    clean = scratch.write(cp.pii_stage(spark, near, SF))
    assert clean.columns == cols and learn_patterns(near, scratch) == {}
    before = {r.doc_id: r.text for r in near.collect()}
    for r in clean.collect():
        t, at, out = before[r.doc_id], 0, []
        for a, k, b in brute.personal(t):
            if a >= at:
                out += [t[at:a], f"[{('email', 'ip', 'card', 'phone')[k]}]"]
            at = max(at, b)
        assert r.text == "".join(out) + t[at:]

    mixed = scratch.write(cp.mixing_stage(spark, clean, SF))
    assert mixed.columns == cols
    n = Counter(r.doc_id for r in mixed.collect())
    assert set(n) == {r.doc_id for r in clean.collect()} and max(n.values()) <= 2

    packed = cp.packing_stage(spark, mixed, SF).collect()
    assert sum(r.length for r in packed) == sum(len(brute.WORD.findall(r.text)) for r in mixed.collect())


def test_run(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "bin", "capacity", "offset"] and got.count() > 0


def test_near_duplicate_stage_keeps_one_row_of_a_repeated_id(spark):
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "x"), (3, "", "x"), (3, None, "x"), (None, "a b c d e f g h", "x"), (4, "q r s t u v w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    got = [(r.doc_id, r.gone_id) for r in cp.near_duplicate_stage(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, "x"), (3, "x"), (4, "x"), (None, "x")], key=repr)


def test_stages_on_edge_rows_with_clashing_columns(spark):
    good = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if not brute.base_quality(r.text)[-1]][:8]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "k", "mine", 7, "t") for r in good]
    rows += [(None, None, None, None, None, "k", "mine", 7, "t"), (900, "", "en", "s", 0, "k", "mine", 7, "t")]
    rows += [(901, "call +1 555 123 4567 or a@b.org", "en", None, 31, "k", "mine", 7, "t")] * 3
    names = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, stage_row int, q_text string"
    docs = spark.createDataFrame(rows, names)
    extra = lambda r: (r.kept, r.n_words, r.stage_row, r.q_text)
    kept = cp.quality_stage(spark, docs, SF)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    got = kept.collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in good} and all(extra(r) == ("k", "mine", 7, "t") for r in got)
    clean = cp.pii_stage(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in clean) == Counter(r[0] for r in rows) and all(extra(r) == ("k", "mine", 7, "t") for r in clean)
    assert {r.text for r in clean if r.doc_id == 901} == {"call [phone] or [email]"} and {r.text for r in clean if r.doc_id is None} == {None}
    mixed = cp.mixing_stage(spark, docs, SF).collect()
    assert {r.doc_id for r in mixed} == {r[0] for r in rows} and all(extra(r) == ("k", "mine", 7, "t") for r in mixed)
    packed = cp.packing_stage(spark, docs, SF).collect()
    assert sum(r.length for r in packed) == sum(len(brute.WORD.findall(r[1] or "")) for r in rows)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
