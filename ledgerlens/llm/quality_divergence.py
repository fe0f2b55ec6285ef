"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's character-class histogram and its histogram of common words
are compared by the Jensen-Shannon distance (base 2, so 0 to 1) with the
reference of its own language, whatever share of the corpus that language has:
the sums over all its documents, and the shares of its common words. References
of languages with a share of the words are literals, so their documents are not
shuffled; those of all others are a table joined on the language. Both hold the
same and give the same distances. Two guards keep short texts from being judged
on too few words or characters.

A language of fewer than ``MIN_REFERENCE_WORDS`` words over the whole corpus
has no reference, and only the base rules decide on its documents: some ten
texts of usual length cannot tell junk among them from the rest.

Defined cases: NULL text has no words (and fails the base rules); a text
without words has empty histograms, distance NULL and is kept by the method
(the base rules decide); very long texts are judged whole; a distance equal to
its limit keeps the document; rows with a NULL doc_id or repeated rows are
judged one by one; NULL and empty language are one language of their own; an
empty table gives an empty result (no references); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "mark", "symbol", "space", "other"]
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_MARKS = ".,;:!?'\"()-"
# the most frequent class first: each step reads only what the ones before it left
_STEPS = [("lower", _LOWER), ("space", WS), ("upper", _LOWER.upper()), ("digit", "0123456789"), ("mark", _MARKS), ("symbol", SYMBOLS)]


MIN_REFERENCE_WORDS = 2_000


@dataclass(frozen=True)
class References:
    """What the corpus teaches. ``words`` and ``classes`` hold the languages of
    at least ``min_language_share`` of all words (at most 1 / share languages);
    common words have ``min_word_share`` of their language's words (at most
    1 / share words a language). ``rare`` has the same of every other language
    of enough words, as a table; None where the corpus has no other language."""

    words: dict[str, dict[str, float]]  # language -> common word -> share
    classes: dict[str, tuple[float, ...]]
    rare: DataFrame | None = None  # r_lang, r_words, r_shares (of the words, then of all others), r_classes

    @property
    def common(self) -> tuple[str, ...]:
        return tuple(sorted(set().union(*self.words.values())))


def words_of(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPLIT))


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Number of words inside ``width``-word windows that occur at least twice
    in the text. Windows are compared by 64-bit hashes within their text."""

    def covered(windows: Column) -> Column:
        marked = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["w"] == F.get(s, j)["w"], F.lit(False))
            hit = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.sort_array(F.filter(hit, lambda i: i.isNotNull()))

        # each window adds the words that the one before it did not cover
        total = F.aggregate(
            _let(marked, starts),
            F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )
        distinct = F.size(F.array_distinct(windows))
        return F.when(distinct == F.size(windows), F.lit(0).cast("bigint")).otherwise(total)

    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n < width, F.lit(0).cast("bigint")).otherwise(_let(windows, covered))


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus words, counts of character classes and the base counts
    (columns prefixed ``q_``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("q_text", t).withColumn("q_words", words_of(t))
    # characters left after taking one class after the other away
    left = F.col("q_text")
    for k, (name, chars) in enumerate(_STEPS):
        d = d.withColumn(f"q_left{k}", F.translate(left, chars, ""))
        d = d.withColumn(f"q_{name}", (F.length(left) - F.length(f"q_left{k}")).cast("bigint"))
        left = F.col(f"q_left{k}")
    d = d.withColumn("q_other", F.length(left).cast("bigint"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    d = d.withColumn("q_lines", lines)
    return (
        d.withColumn("n_words", F.size("q_words").cast("bigint"))
        .withColumn("word_chars", (F.length("q_text") - F.col("q_space")).cast("bigint"))
        .withColumn("n_symbols", F.col("q_symbol"))
        .withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint"))
        .withColumn("n_repeat_words", repeated_window_words(F.col("q_words")))
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_references(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_language_share: float = 0.01, min_word_share: float = 0.005,
    min_reference_words: int = MIN_REFERENCE_WORDS,
) -> References:
    """Class counts and word counts per language over all of ``docs``. Word
    counts are summed map-side before the shuffle; only languages and words
    above the two shares reach the driver (at most 100 and 200 each), the other
    languages stay a table."""
    t = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chars = t
    left = "t"
    for k, (name, cs) in enumerate(_STEPS):
        chars = chars.withColumn(f"l{k}", F.translate(left, cs, "")).withColumn(name, F.length(left) - F.length(f"l{k}"))
        left = f"l{k}"
    chars = chars.withColumn("other", F.length(left)).withColumn("n", F.size(words_of(F.col("t"))))
    totals = chars.groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in CLASSES]).filter("n > 0")
    cached = totals.persist()
    everything, n_langs = cached.agg(F.sum("n"), F.count("*")).first()
    if not everything:
        cached.unpersist()
        return References({}, {})
    enough = F.col("n") >= min_reference_words
    langs = {r["lang"]: r for r in cached.filter(enough & (F.col("n") >= min_language_share * everything)).collect()}
    cached.unpersist()
    counts = t.select("lang", F.explode(words_of(F.lower("t"))).alias("word")).groupBy("lang", "word").count()
    bar = F.lit(None).cast("double")
    for name, r in langs.items():
        bar = F.when(F.col("lang") == name, F.lit(min_word_share * r["n"])).otherwise(bar)
    found: dict[str, dict[str, float]] = {name: {} for name in langs}
    for r in counts.filter(F.col("count") >= bar).collect():
        found[r["lang"]][r["word"]] = r["count"] / langs[r["lang"]]["n"]
    classes = {name: tuple(r[c] / max(1, sum(r[x] for x in CLASSES)) for c in CLASSES) for name, r in langs.items()}
    rare = None
    if n_langs > len(langs):
        others = ~F.col("lang").isin(list(langs))
        size = totals.filter(others & enough)
        total = sum((F.col(c) for c in CLASSES), F.lit(0))
        shares = F.array(*[F.col(c) / F.greatest(F.lit(1), total) for c in CLASSES])
        size = size.select(F.col("lang").alias("r_lang"), F.col("n").alias("r_n"), shares.alias("r_classes"))
        own = counts.filter(others).join(size.select("r_lang", "r_n"), F.col("lang") == F.col("r_lang")).filter(F.col("count") >= min_word_share * F.col("r_n"))
        own = own.groupBy(F.col("lang").alias("w_lang")).agg(F.sort_array(F.collect_list(F.struct("word", (F.col("count") / F.col("r_n")).alias("share")))).alias("w"))
        rare = size.join(own, F.col("r_lang") == F.col("w_lang"), "left")
        known = F.coalesce(F.col("w.share"), F.array().cast("array<double>"))
        rest = F.greatest(F.lit(0.0), 1 - F.aggregate(known, F.lit(0.0), lambda a, x: a + x))
        rare = rare.select("r_lang", F.coalesce("w.word", F.array().cast("array<string>")).alias("r_words"), F.concat(known, F.array(rest)).alias("r_shares"), "r_classes")
    return References(found, classes, rare)


def _shares(counts: Column) -> Column:
    return _let(counts, lambda c: _let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda n: F.transform(c, lambda x: x / n)))


def _js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two aligned share arrays; 0 * log 0 is 0."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def _class_counts() -> Column:
    return F.array(*[F.col(f"q_{c}").cast("double") for c in CLASSES])


def _word_shares(seen: Column, keys: Column) -> Column:
    """Shares of the words in ``keys`` and of all others; ``seen`` are the
    words of the text that may be among them."""
    # the common words only, each between two spaces of its own, so that one replace() counts it
    padded = F.concat(F.lit(" "), F.array_join(seen, "  "), F.lit(" "))

    def histogram(s: Column) -> Column:
        c = F.transform(keys, lambda w: (F.octet_length(s) - F.octet_length(F.replace(s, w, F.lit("")))) / F.octet_length(w))
        return _let(c, lambda k: F.concat(k, F.array(F.col("n_words") - F.aggregate(k, F.lit(0.0), lambda a, x: a + x))))

    return _shares(_let(F.lower(padded), histogram))


def _measured(f: DataFrame, seen: Column, keys: Column, shares: Column, classes: Column) -> DataFrame:
    """Adds both distances to a reference, NULL without one or without histogram."""
    far_class = _js_distance(_shares(_class_counts()), classes)
    far_words = _js_distance(_word_shares(seen, keys), shares)
    f = f.withColumn("class_distance", F.when(classes.isNotNull() & (F.length("q_text") > 0), far_class))
    return f.withColumn("word_distance", F.when((F.size(keys) > 0) & (F.col("n_words") > 0), far_words))


def _array(values, of=float) -> Column:
    return F.array(*[F.lit(of(x)) for x in values]).cast("array<double>" if of is float else "array<string>")


def divergence(features: DataFrame, refs: References, lang: str = "lang") -> DataFrame:
    """Adds class_distance and word_distance (NULL where there is nothing to compare)."""
    name = F.coalesce(F.col(lang), F.lit(""))

    def of_language(values: dict[str, Column], kind: str) -> Column:
        out = F.lit(None).cast(f"array<{kind}>")
        for k, v in sorted(values.items()):
            out = F.when(name == k, v).otherwise(out)
        return out

    keys = {k: _array((f" {w} " for w in sorted(q)), str) for k, q in refs.words.items()}
    shares = {k: _array([*(q[w] for w in sorted(q)), max(0.0, 1 - sum(q.values()))]) for k, q in refs.words.items()}
    classes = {k: _array(v) for k, v in refs.classes.items()}
    found = F.filter("q_words", lambda w: F.lower(w).isin(list(refs.common)))
    own = [of_language(keys, "string"), of_language(shares, "double"), of_language(classes, "double")]
    if refs.rare is None:
        return _measured(features, found, *own)
    # only documents of the other languages are joined, so a hot language is not shuffled
    literal = F.lit(False) if not refs.classes else name.isin(list(refs.classes))
    f = features.filter(~literal).join(refs.rare, name == F.col("r_lang"), "left")
    padded = F.transform("r_words", lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    found_rare = F.filter("q_words", lambda w: F.array_contains("r_words", F.lower(w)))
    f = _measured(f, found_rare, padded, F.col("r_shares"), F.col("r_classes")).drop("r_lang", "r_words", "r_shares", "r_classes")
    return _measured(features.filter(literal), found, *own).unionByName(f)


def quality(
    docs: DataFrame, refs: References | None = None, text: str = "text", lang: str = "lang",
    max_class_distance: float = 0.28, max_word_distance: float = 0.42, min_chars: int = 200, min_words: int = 50,
) -> DataFrame:
    """``docs`` plus the base counts, base_failed, both distances and kept.
    A distance above its limit rejects only texts at least as long as its guard."""
    refs = refs or learn_references(docs, text, lang)
    f = divergence(base_features(docs, text), refs, lang)
    far_class = (F.length("q_text") >= min_chars) & (F.col("class_distance") > max_class_distance)
    far_words = (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance)
    f = f.withColumn("base_failed", base_failed())
    f = f.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far_class, F.lit(False)) & ~F.coalesce(far_words, F.lit(False)))
    return f.drop(*[c for c in f.columns if c.startswith("q_") and c not in docs.columns])

