"""Trees, likeness and edited texts against a plain version."""

import hashlib
import json
import random
import re

import xxhash
from pyspark.sql import functions as F
from test_llm_brute import SF, _docs, edge_rows

from ledgerlens.llm import queries as q
from ledgerlens.llm._shared import Scratch
from ledgerlens.llm.merkle_fingerprints import edited_paragraphs, fingerprints, from_text, half_edits, likeness, repeat_rows, to_text

WORD = re.compile(r"(?<=[ \t\n\x0b\f\r⺀-퟿豈-﫿])(?=[^ \t\n\x0b\f\r])")
FIELDS = ("root", "pieces", "paragraphs", "paragraph_ends", "sections", "section_ends")


def _hash(s):
    h = xxhash.xxh64(s.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _cut(items, is_end):
    out, run = [], []
    for x in items:
        run.append(x)
        if is_end(x):
            out.append(run)
            run = []
    return out + [run] if run else out


def _ends(runs):
    total, out = 0, []
    for r in runs:
        total += len(r)
        out.append(total)
    return out


def plain_tree(text, words=8, paragraphs=4):
    t = text or ""
    pieces = _cut(WORD.split(t) if t else [], lambda w: "\n" in w or _hash(w) % words == 0)
    leaves = [(_sha("leaf" + "".join(p)), "\n" in p[-1]) for p in pieces]
    lines = _cut(leaves, lambda x: x[1])
    paras = [_sha("paragraph" + "".join(x[0] for x in r)) for r in lines]
    runs = _cut(paras, lambda h: _hash(h) % paragraphs == 0)
    sections = [_sha("section" + "".join(r)) for r in runs]
    short = lambda hs: [_hash(h) >> 32 for h in hs]
    return (_sha("root" + "".join(sections)), short(x[0] for x in leaves), short(paras), _ends(lines), short(sections), _ends(runs))


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    x, y = set(a[1]), set(b[1])
    return 2.0 * len(x & y) / (len(x) + len(y) + 2)


def plain_edits(rows):
    """[(doc_id, text, edited, next text)] by descending id, NULL last."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), _sha(r[1])))
    out = []
    for k, (d, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((d, t, t[: len(t) - half] + other[:half], other))
    return out


def more_rows():
    rng = random.Random(12)
    bits = ["a", "é ", "\U0001f600", " ", "\n", "\t", "\x0b", "word ", "the ", "of\n", "漢字", "かな", "\0", " ", " "]
    rows = [(1000 + k // 2, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60))), "en", "a") for k in range(200)]
    rows += [(5000, "same text", "en", "a")] * 7 + [(5000, "other text", "en", "a")] * 3
    return rows + [(7000, "ein langer satz mit wörtern\n" * 20_000, "de", "a")]


def test_trees(spark):
    rows = edge_rows() + more_rows()
    docs = _docs(spark, rows).withColumn("_merkle0", F.lit("mine"))
    for words, paragraphs in ((8, 4), (2, 1), (1, 3)):
        got = fingerprints(docs, piece_words=words, section_paragraphs=paragraphs)
        assert got.columns == [*docs.columns, "merkle"]
        back = got.withColumn("again", from_text(to_text(F.col("merkle"))))
        for r in back.collect():
            want = plain_tree(r.text, words, paragraphs)
            assert tuple(r.merkle[f] for f in FIELDS) == want and r.again == r.merkle and r["_merkle0"] == "mine"
    assert fingerprints(docs.limit(0)).count() == 0


def test_an_edit_is_located(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(200)) + "\n" for _ in range(300)]
    edited = lines[:]
    edited[140] = "x" + edited[140]
    moved = lines[:70] + ["a new line\n"] + lines[70:]
    df = spark.createDataFrame([("".join(lines), "".join(x)) for x in (lines, edited, moved)], "a string, b string")
    df = fingerprints(fingerprints(df, "a", "ta"), "b", "tb")
    a, b = F.col("ta"), F.col("tb")
    got = df.select(edited_paragraphs(a, b).alias("ab"), edited_paragraphs(b, a).alias("ba"), likeness(a, b).alias("like")).collect()
    assert [(r.ab, r.ba) for r in got] == [([], []), ([140], [140]), ([], [70])]
    assert got[0].like == 1.0 and 0.97 < got[1].like < 1 and 0.97 < got[2].like < 1


def test_half_edits(spark):
    rows = edge_rows() + more_rows()
    want = []
    for d, t, e, other in plain_edits([r[:2] for r in rows]):
        want.append((d, len(t), e, plain_tree(t)[0], plain_tree(e)[0], plain_tree(other)[0]))
    for block in (64, 1, 7):
        got = half_edits(_docs(spark, rows), Scratch(spark, "t"), block_rows=block)
        out = repeat_rows(got, "many", step=2).collect()
        have = [(r.doc_id, r.n_chars, r.edited, r.tree.root, r.edited_tree.root, r.next_tree.root) for r in out]
        assert sorted(have, key=repr) == sorted(want, key=repr)


def test_few_rows(spark):
    for texts, want in (([], []), (["abcdef"], ["abcabc"]), ([None], [""]), (["ab", "xyz"], ["ax", "xya"]), (["same"] * 3, ["sasa"] * 3)):
        docs = spark.createDataFrame([(len(texts) - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        assert sorted(r.edited for r in repeat_rows(half_edits(docs, Scratch(spark, "t")), "many").collect()) == sorted(want)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in q.op12_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    near, far, halved = [], [], []
    for d, t, e, other in plain_edits(rows):
        r, a, b, c = got[d], plain_tree(t), plain_tree(e), plain_tree(other)
        assert r.n_chars == len(t) and r.edited_sha256 == _sha(e)
        assert json.loads(r.fingerprint) == dict(zip(FIELDS, a, strict=True))
        assert json.loads(r.edited_fingerprint) == dict(zip(FIELDS, b, strict=True))
        assert (r.near_edited, r.near_next) == (plain_likeness(a, b), plain_likeness(a, c))
        if len(t.split()) >= 60:
            halved.append(r.near_edited)
        near.append(r.near_edited)
        far.append(r.near_next)
    # texts of some length are nearer to their edited form than to another text
    assert sum(n > f for n, f in zip(near, far, strict=True)) > 0.95 * len(near)
    assert sum(0.2 < x < 0.8 for x in halved) > 0.9 * len(halved)
