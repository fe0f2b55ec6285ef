"""Places where an operator once did less than the whole job."""

import random

from ledgerlens.llm import pii_bootstrap
from ledgerlens.llm._shared import Scratch
from ledgerlens.llm.pii_bootstrap import _Contexts, find_spans, learn_patterns, mask, pattern_table
from ledgerlens.llm.quality_divergence import learn_references, quality
from ledgerlens.llm.toxicity_segments import ToxicModel, toxic_passages, toxicity


def _calls(rng, n):
    return [f"word{i % 3} please call +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} today" for i in range(n)]


def test_every_accepted_pattern_is_used_however_many(spark):
    rng = random.Random(2)
    texts = _calls(rng, 40) + ["mail b@x.org or please call 0555-123456 today", "please call 0555-123456 today", "please call 0555-123456 today", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = pattern_table(docs, Scratch(spark, "t"))
    assert table.count() > 1 and "max_patterns" not in pattern_table.__code__.co_varnames
    sent = sorted(map(tuple, find_spans(docs, table).collect()))
    joined = sorted(map(tuple, find_spans(docs, table, most=0).collect()))
    assert sent == joined and [r[-1] for r in joined[40:]] == ["email:5:12,phone:28:39", "phone:12:23", "phone:12:23", "", ""]
    sent = {r.doc_id: r.text for r in mask(docs, table).collect()}
    assert sent == {r.doc_id: r.text for r in mask(docs, table, most=0).collect()}
    assert sent[41] == "please call [phone] today" and sent[43] is None


def test_patterns_past_the_ten_thousandth_are_used(spark):
    spell = "translate(id, '0123456789', 'abcdefghij')"
    table = spark.range(pii_bootstrap.BROADCAST_PATTERNS + 1).selectExpr(f"concat({spell}, ' _') AS pattern", "3 AS kind")
    docs = table.selectExpr("CAST(1 AS bigint) AS doc_id", "replace(pattern, '_', '1234567') AS text")
    got = find_spans(docs, table).collect()
    assert len(got) == pii_bootstrap.BROADCAST_PATTERNS + 1 and all(r.spans.startswith("phone:") for r in got)


def test_grouped_numbers_and_short_identifiers_are_candidates(spark):
    rng = random.Random(3)
    texts = _calls(rng, 40) + ["please call 020 7946 0958 today", "please call AB12345 today", "please call (020) 7946-0958, 15 times", "sold 12 of 20 7 times"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = pattern_table(docs, Scratch(spark, "t"))
    got = {r.doc_id: r.spans for r in find_spans(docs, table).collect()}
    assert [got[40 + k] for k in range(4)] == ["phone:12:25", "phone:12:19", "phone:12:27", ""]
    assert got == {r.doc_id: r.spans for r in find_spans(docs, table, most=0).collect()}
    assert {r.doc_id: r.text for r in mask(docs, table).collect()}[40] == "please call [phone] today"


def test_words_from_half_a_percent_are_in_the_reference(spark):
    words = ["often"] * 993 + ["seldom"] * 7
    docs = spark.createDataFrame([(1, " ".join(words * 3), "en")], "doc_id long, text string, lang string")
    assert set(learn_references(docs).common) == {"often", "seldom"}


def test_toxic_passages_late_in_a_text_and_repeated_ones_are_found(spark):
    model = ToxicModel({"bad": 6.0, "worse": 6.0, "worst": 6.0}, -0.05, 1.0, 0.1, -3.0, 1.0)
    alone = "".join(f"{w} " + "x " * 800 for w in ("bad", "worse", "worst") * 2)
    texts = [alone + "bad worse worst", ("bad worse worst " + "x " * 600) * 5, "bad " * 50, "bad " * 2, alone]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[], [], [], [], []]
    for r in sorted(toxic_passages(docs, model).collect()):
        got[r.doc_id].append((r.first_token, r.end_token))
    assert got[0] == [(4806, 4809)] and got[1] == [(603 * k, 603 * k + 3) for k in range(5)] and got[2] == [(0, 50)]
    found = {r.doc_id: r.evidence for r in toxicity(docs, model).collect()}
    # repetition is damped in the evidence alone
    assert found[0] > 0 and found[4] == 0 and 0 < found[2] <= found[3]


def test_long_repetition_of_a_passage_is_scored(spark):
    model = ToxicModel({"bad": 6.0, "worse": 6.0, "worst": 6.0}, -0.05, 1.0, 0.1, -3.0, 1.0)
    texts = ["bad worse worst " * n for n in (1, 2, 1000, 100_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.evidence for r in toxicity(docs, model).collect()}
    assert got[0] > 0 and got[1] > 0 and all(v >= 0 for v in got.values())


def test_rare_languages_are_judged_by_their_own_reference(spark):
    rng = random.Random(6)
    english = ["the", "of", "and", "house", "green", "walks", "under", "seven"]
    russian = ["и", "в", "дом", "зелёный", "идёт", "под", "семь", "не"]
    text = lambda v, n: " ".join(f"{rng.choice(v)}{rng.choice(v)}" if rng.random() < 0.6 else rng.choice(v) for _ in range(n))
    rows = [(i, text(english, 2000), "en") for i in range(200)]
    rows += [(1000 + i, text(russian, 200), "ru") for i in range(15)]  # 3,000 words, less than a hundredth
    rows += [(2000, text(russian, 200), None), (2001, "#$% 12 " * 100, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").persist()
    refs = learn_references(docs)
    assert set(refs.classes) == {"en"} and [r.r_lang for r in refs.rare.collect()] == ["ru"]
    got = {r.doc_id: r for r in quality(docs, refs).select("doc_id", "base_failed", "kept", "class_distance").collect()}
    assert len(got) == len(rows) and all(r.kept or r.base_failed for i, r in got.items() if i != 2001)
    assert sum(got[1000 + i].kept for i in range(15)) >= 14
    assert got[2000].class_distance is None and not got[2001].kept and got[2001].class_distance > 0.28


def test_contexts_have_no_length_limit(spark):
    long = "w" * 500
    t = f"{long} {long}x {' ' * 200}id7 {' ' * 100}{long}y a@b.co,id8,c@d.ef"
    places = [(m, m + 3) for m in (t.index("id7"), t.index("id8"))] + [(t.index("a@b"), t.index(",id8"))]
    first, second = (_Contexts(t, places).of(*p) for p in places[:2])
    assert len(first) == 3 and len({x for p in first for x in p.split(" ")}) == 4  # three long words, told apart
    assert second[0] == ", _" and second[2] == ", _ ,c@d.ef"
    # many identifiers in one run without a space, in time that follows its length
    glued = ",".join(f"u{k}@x.com" for k in range(20_000))
    docs = spark.createDataFrame([(1, glued)], "doc_id long, text string")
    assert find_spans(docs, {", _": 0}).first()["n_email"] == 20_000
    assert learn_patterns(docs, Scratch(spark, "t")) == {", _": 0, ", _ ,": 0}
    # identifiers that agree on their first 200 characters are different instances: 40 of 55 are believed, not of 41
    texts = [f"token {'a' * 300}{k}" for k in range(15)] + [f"token me{k}@x.com" for k in range(40)]
    assert "token _" not in learn_patterns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t"))
