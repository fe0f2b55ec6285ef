"""Straightforward versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_quality(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed


class Sets:
    """Union-find with the least member as the name."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard(rows, n, percent):
    """(doc_id, text) -> {doc_id: (set size, component)}"""
    sets = [(d, shingles(t, n)) for d, t in rows]
    u = Sets()
    for d, _ in sets:
        u.find(d)
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            i = len(x & y)
            if 100 * i >= percent * (len(x) + len(y) - i):
                u.join(a, b)
    return {d: (len(s), u.find(d)) for d, s in sets}


def passages(rows, length):
    """(doc_id, text) -> [(doc_id, n_bytes, n_removed, n_spans, sha256)]"""
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, r in raws:
        if d is not None:
            for i in range(len(r) - length + 1):
                k = r[i : i + length]
                if d < first.get(k, math.inf):
                    first[k] = d
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        if d is not None:
            for i in range(len(r) - length + 1):
                if first[r[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def backoff_scores(texts, factor, order):
    """[(n_tokens, n_backoff, n_unigram, log score)] per text; counts of other
    texts, but for single words."""
    toks = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    grams = lambda t, n: Counter(zip(*(t[k:] for k in range(n)), strict=False))
    all_, n = [Counter() for _ in range(order + 1)], sum(map(len, toks))
    for t in toks:
        for k in range(1, order + 1):
            all_[k].update(grams(t, k))
    out = []
    for t in toks:
        own = [Counter(), *(grams(t, k) for k in range(1, order + 1))]
        s, back, uni = 0.0, 0, 0
        for i in range(len(t)):
            steps = 0
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(t[i - k + 1 : i + 1])
                seen = all_[k][gram] - own[k][gram]
                if k == 1:
                    p = all_[1][gram] / n
                    uni += steps > 0
                elif seen:
                    p = seen / (all_[k - 1][gram[:-1]] - own[k - 1][gram[:-1]])
                    break
                else:
                    steps += 1
            s += math.log(p) + steps * math.log(factor)
            back += steps > 0
        out.append((len(t), back, uni, s))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def personal(text):
    """Sorted (start, kind, end) of the fixed patterns."""
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def vectors(rows, threshold):
    """(vec_id, vector or None) -> [(vec_id, n_links, component)]"""
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        s = math.sqrt(sum(x * x for x in v)) if ok else 0
        unit.append([x / s for x in v] if ok else None)
    u, links = Sets(), defaultdict(int)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = unit[i], unit[j]
        if a and b and len(a) == len(b) and sum(x * y for x, y in zip(a, b, strict=True)) >= threshold:
            links[i] += 1
            links[j] += 1
            u.join(rows[i][0], rows[j][0])
    return [(d, links[i], u.find(d)) for i, (d, _) in enumerate(rows)]
