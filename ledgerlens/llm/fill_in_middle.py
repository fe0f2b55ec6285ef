"""Fill-in-the-middle transformation with cuts from a wavelet matrix.

Every byte of a text gets one of eight character classes, three bits: is it
whitespace, is it a line end (whitespace) or a UTF-8 continuation byte (other),
and does its run of (non-)whitespace end here. A wavelet matrix over the
classes answers rank queries, and sums of ranks are boundary counts: words
ended before a place, lines ended before it, code points before it. Both cuts
are found by bisection on those counts, for all texts of a slice at once. A
slice is whole texts of about 1 MB, so memory follows the slice or the longest
single text.

Cuts fall on units: a token (whitespace and the word after it; trailing
whitespace is one more token) or a line. The cuts become columns of the rows,
and the transformed text is put together by Spark from them.

Defined cases: NULL text is the empty text, which stays plain; a text that
holds a sentinel stays plain; a text of whitespace only is one token; very
long texts are cut whole; a NULL id hashes as the empty string; repeated rows
and equal ids are cut alike where their texts are; an empty table gives an
empty result; other columns stay, and new columns avoid their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._shared import fresh
from ledgerlens.llm._words import IS_SPACE, text_chunks

# The sentinels of the query, before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

# classes: 4 non-space + 2 line end / continuation byte + 1 last of its run
_WORD_END = (5, 7)
_LINE_END = (2, 3)
_CONTINUED = (6, 7)
_LEVELS = 3
_ONE = np.uint64(1)


class _Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        low = self.words[w] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE)
        return self.before[w] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank over a sequence of symbols 0 to 2**levels - 1."""

    def __init__(self, symbols: np.ndarray, levels: int = _LEVELS):
        self.levels, self.rows, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.rows.append(_Bits(bit))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
            self.zeros.append(len(bit) - int(bit.sum()))

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``i`` symbols."""
        left, right = np.zeros_like(i), i
        for k, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            ones_l, ones_r = row.rank(left), row.rank(right)
            if (symbol >> (self.levels - 1 - k)) & 1:
                left, right = zeros + ones_l, zeros + ones_r
            else:
                left, right = left - ones_l, right - ones_r
        return right - left


def classes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that lie between ``offs``."""
    space = IS_SPACE[buf]
    ends = np.ones(len(buf), bool)
    ends[:-1] = space[1:] != space[:-1]
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    ends[last] = True
    second = np.where(space, buf == 10, (buf & 0xC0) == 0x80)
    return (~space * 4 + second * 2 + ends).astype(np.uint8)


class TextUnits:
    """Boundary counts of a slice of texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, unit: str):
        self.kinds = classes(buf, offs)
        self.matrix = WaveletMatrix(self.kinds)
        self.start, self.end = offs[:-1], offs[1:]
        self.symbols = _WORD_END if unit == "token" else _LINE_END
        self.inner = self.ended(self.end)
        # what follows the last boundary is one more unit
        last = self.kinds[np.maximum(self.end - 1, 0)] if len(buf) else np.zeros(len(self.end), np.uint8)
        self.n = self.inner + ((self.end > self.start) & ~np.isin(last, self.symbols))

    def _between(self, symbols: tuple[int, ...], i: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(s, i) - self.matrix.rank(s, self.start) for s in symbols)

    def ended(self, i: np.ndarray) -> np.ndarray:
        """Units that end before place ``i`` of each text."""
        return self._between(self.symbols, i)

    def chars(self, i: np.ndarray) -> np.ndarray:
        """Code points before place ``i`` of each text."""
        return i - self.start - self._between(_CONTINUED, i)

    def place(self, k: np.ndarray) -> np.ndarray:
        """The place where the ``k``-th unit ends (the text's start for 0)."""
        lo, hi = self.start.copy(), self.end.copy()  # the least place with k units ended is in [lo, hi]
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            enough = self.ended(mid) >= k
            lo, hi = np.where(enough | (lo >= hi), lo, mid + 1), np.where(enough, np.minimum(mid, hi), hi)
        return np.where(k > self.inner, self.end, np.where(k <= 0, self.start, lo))


_CUTS = "struct<n: bigint, prefix_chars: bigint, middle_chars: bigint>"


def cut_column(text: Column, first: Column, second: Column, unit: str = "token") -> Column:
    """Units of the text (n) and code points of prefix and middle, where the
    prefix ends after the smaller of ``first % (n + 1)`` and ``second % (n + 1)``
    units and the middle after the larger."""
    if unit not in ("token", "line"):
        raise ValueError("unit must be 'token' or 'line'")

    @F.arrow_udf(_CUTS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            draws = [np.asarray(x.fill_null(0).to_numpy(zero_copy_only=False), np.int64) for x in (first, second)]
            out = np.zeros((3, len(texts)), np.int64)
            for lo, hi, buf, offs in text_chunks(texts):
                units = TextUnits(buf, offs, unit)
                a, b = (x[lo:hi] % (units.n + 1) for x in draws)
                cut = units.place(np.minimum(a, b))
                out[0, lo:hi] = units.n
                out[1, lo:hi] = units.chars(cut)
                out[2, lo:hi] = units.chars(units.place(np.maximum(a, b))) - out[1, lo:hi]
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "prefix_chars", "middle_chars"])

    return run(text, first, second)


def _check(sentinels: tuple[str, str, str]) -> None:
    """A sentinel may begin inside no other one, else the text could not be told
    from its sentinels when it is put together again."""
    for a, b in product(sentinels, repeat=2):
        whole = a != b and a in b
        if not a or whole or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"sentinels {sentinels} can overlap")
    if len(set(sentinels)) != 3:
        raise ValueError("sentinels must differ")


def fill_in_middle(
    docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS,
    unit: str = "token", doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` plus ``fim_n`` (units), ``fim_form`` (plain, psm or spm),
    ``fim_prefix_chars``, ``fim_middle_chars`` (code points, NULL if plain) and
    ``fim_text``. ``rate`` percent of the texts are transformed, ``spm_rate``
    percent of those with the suffix first; all draws come from
    sha256(``seed``:id), so a text is cut alike in every run."""
    _check(sentinels)
    names = {c: fresh(docs, c) for c in ("fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")}
    whole, draw, cut = fresh(docs, "fim_whole"), fresh(docs, "fim_draw"), fresh(docs, "fim_cut")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    d = docs.withColumn(whole, F.coalesce(F.col(text), F.lit(""))).withColumn(draw, digest)
    h = [F.conv(F.substring(draw, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]
    d = d.withColumn(cut, cut_column(F.col(whole), h[0], h[1], unit))
    t, a, b = F.col(whole), F.col(cut)["prefix_chars"], F.col(cut)["middle_chars"]
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains(t, F.lit(s))
    form = F.when((t == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    d = d.withColumn(names["fim_form"], form)
    kind = F.col(names["fim_form"])
    to_int = lambda c: c.cast("int")  # noqa: E731  substring counts in int
    prefix = F.substring(t, F.lit(1), to_int(a))
    middle = F.substring(t, to_int(a + 1), to_int(b))
    suffix = F.substring(t, to_int(a + b + 1), F.lit(2**31 - 1))
    p, s, m = map(F.lit, sentinels)
    out = (
        F.when(kind == "plain", t)
        .when(kind == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    d = (
        d.withColumn(names["fim_n"], F.col(cut)["n"])
        .withColumn(names["fim_prefix_chars"], F.when(kind != "plain", a))
        .withColumn(names["fim_middle_chars"], F.when(kind != "plain", b))
        .withColumn(names["fim_text"], out)
    )
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(n) for n in names.values()])


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from a transformed text and its form."""
    _check(sentinels)
    p, s, m = sentinels
    at = lambda x: F.locate(x, output)  # noqa: E731  a text in this form holds each sentinel once
    rest = F.lit(2**31 - 1)
    part = lambda x, y: F.substring(output, at(x) + len(x), at(y) - at(x) - len(x))
    middle = F.substring(output, at(m) + len(m), rest)
    return (
        F.when(form == "psm", F.concat(part(p, s), middle, part(s, m)))
        .when(form == "spm", F.concat(part(p, m), middle, part(s, p)))
        .otherwise(output)
    )
