"""Cuts and texts against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_brute import SF, _docs, edge_rows

from ledgerlens.llm import queries as q
from ledgerlens.llm.fill_in_middle import WaveletMatrix, fill_in_middle, restore

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, rate=50, spm=80, seed=42, unit=TOKEN):
    """(n, form, prefix_chars, middle_chars, output)"""
    t = text or ""
    units = [m.group() for m in unit.finditer(t)]
    assert "".join(units) == t
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def more_rows():
    rng = random.Random(11)
    bits = ["a", "é", "\U0001f600", " ", "\n", "\t", "\x0b", "word", " ", " ", "<", "<P", "<S", "S>", ">", "\0", "<P>"]
    rows = [(1000 + k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), "en", "a") for k in range(400)]
    rows += [(2000 + k, t, "en", "a") for k, t in enumerate(["<", "<<S", "x<S", "<M>", " <P> ", "  a  ", "\n\n", "a", "a "] * 6)]
    rows += [(3000, "lang wörter und mehr \n" * 60_000, "de", "a")]
    return rows


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        s = rng.integers(0, 8, size).astype(np.uint8)
        w = WaveletMatrix(s)
        at = np.arange(size + 1)
        for c in range(8):
            assert w.rank(c, at).tolist() == [0, *np.cumsum(s == c).tolist()]


@pytest.mark.parametrize("unit", ["token", "line"])
def test_transformation(spark, unit):
    rows = edge_rows() + more_rows()
    docs = _docs(spark, rows).withColumn("fim_text", F.lit("mine")).withColumn("fim_n", F.lit(-1))
    got = fill_in_middle(docs, rate=90, spm_rate=50, unit=unit)
    assert got.columns[: len(docs.columns)] == docs.columns
    got = got.withColumn("back", restore(F.col("fim_text_"), F.col("fim_form")))
    cols = ("doc_id", "fim_n_", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text_", "back", "fim_text", "fim_n", "kept")
    have = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    units = TOKEN if unit == "token" else LINE
    want = sorted(((d, *plain(d, t, 90, 50, unit=units), t or "", "mine", -1, "y") for d, t, *_ in rows), key=repr)
    assert have == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        *cut, out = plain(r.doc_id, r.text)
        want.append((r.doc_id, *cut, sha(out), sha(r.text or "")))
    got = q.op11_fill_in_middle(spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sentinels_that_overlap_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "cc"), ("", "<S>", "<M>"), ("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)
    out = fill_in_middle(docs, rate=100, sentinels=("[p]", "[s]", "[m]")).first()
    assert out.fim_form != "plain" and out.fim_text.count("[") == 3
