"""Word pointers, counts and shares against a plain version."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from test_llm_brute import SF, _docs, edge_rows

from ledgerlens.llm import queries as q
from ledgerlens.llm._shared import Scratch
from ledgerlens.llm.source_audit import sorted_pointers, source_audit, term_counts, word_pointers

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [w.translate(brute.LOWER) for w in TERM.findall(text or "")]


def audit(rows, min_docs, top):
    """Rows (lang, source, part, item, value, rank) from (id, text, lang, source)."""
    n, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in rows:
        lang, source, w = lang or "", source or "", terms_of(t)
        sources[lang].add(source)
        n[lang, source].update(w)
        df[lang].update(set(w))
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, c in df[lang].items() if c >= min_docs)
        whole = sum((n[lang, s] for s in names), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(n[lang, s]) for s in names}
        for s in names:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in names if o != s]
            best = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", best, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:limit], 1)]
    return sorted(out)


def more_rows():
    rng = random.Random(13)
    stem = "x" * 70
    vocab = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghij", "ABCDEFGHI", "éa", "É", "ünïcode", "\U0001f600", stem, stem + "y", stem + "yz", stem[:64]]
    joins = [" ", "\n", "1", "'", "@", "[", "`", "{", "\x7f", "_"]
    rows = []
    for k in range(400):
        words = rng.choices(vocab, [3, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 12))
        lang = rng.choice(["en", "en", "de", None, ""])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "é", None, ""])
        rows.append((k % 390, "".join(w + rng.choice(joins) for w in words), lang, source))
    rows += [(500, None, "xx", "only empty"), (501, "", "xx", "no words"), (502, "12 34", "yy", "alone")]
    return rows


def _slice(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_pointers_and_their_order():
    for texts in ([], [""], ["", "a", "b", ""], ["ab", "cd ef", "", "gh"], [r[1] or "" for r in more_rows()], ["y" * 5000, "y" * 5000, "y" * 4999 + "z", "y" * 64]):
        buf, offs = _slice(texts)
        s, e, of = word_pointers(buf, offs)
        words = [buf[a:b].tobytes() for a, b in zip(s, e, strict=True)]
        assert [(int(d), w) for d, w in zip(of, words, strict=True)] == [(k, w.encode()) for k, t in enumerate(texts) for w in TERM.findall(t)]
        low = np.zeros(len(buf) + 8, np.uint8)
        low[: len(buf)] = buf
        order, first = sorted_pointers(low, s, e)
        assert order.tolist() == sorted(range(len(words)), key=lambda k: (words[k], k))
        ordered = [words[k] for k in order]
        assert first.tolist() == [k == 0 or w != ordered[k - 1] for k, w in enumerate(ordered)]


def test_counts(spark):
    rows = edge_rows() + more_rows()
    want = defaultdict(lambda: [0, 0])
    for _, t, lang, source in rows:
        for w, c in Counter(terms_of(t)).items():
            want[lang or "", source or "", w][0] += c
            want[lang or "", source or "", w][1] += 1
    got = {(r.lang, r.source, r.term): [r.n, r.df] for r in term_counts(_docs(spark, rows).repartition(5)).collect()}
    assert got == dict(want)


@pytest.mark.parametrize(("min_docs", "top", "block"), [(30, 50, 512), (2, 3, 4), (1, 5, 1), (10_000, 50, 512)])
def test_audit(spark, min_docs, top, block):
    rows = edge_rows() + more_rows()
    got = source_audit(_docs(spark, rows), Scratch(spark, "t"), min_docs, top, block)
    assert sorted(map(tuple, got.collect())) == audit(rows, min_docs, top)


def test_empty_table(spark):
    assert source_audit(_docs(spark, edge_rows()).limit(0), Scratch(spark, "t")).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = q.op13_source_divergence_audit(spark, SF)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit(rows, 30, 50)
