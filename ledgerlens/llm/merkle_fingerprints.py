"""Document fingerprints: Merkle trees over paragraphs and sections, in
DataFrame functions only.

A text is cut into words (each with the whitespace after it), words into
pieces, pieces into paragraphs (lines) and paragraphs into sections. A piece
ends at a line end or where the hash of its last word says so, a section where
the hash of its last paragraph says so; so an edit moves no cut far from it.
Pieces are the leaves. Every node is the SHA-256 of its level and its children,
so two roots are equal exactly when the texts are. Below the root, a node is
kept as 32 bits of its hash: branches whose numbers differ locate an edit, and
the share of common leaves is the likeness of two texts.

Defined cases: NULL text is the empty text, whose tree has a root only; text
without line ends is one paragraph; a word without whitespace, however long, is
one piece, but every character of scripts written without spaces is a word of
its own; repeated rows and equal texts have equal fingerprints, whatever their
ids; an empty table gives an empty result; other columns stay, and the new
column avoids their names. Very long texts are cut whole, each in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.ordinal import number_rows
from ledgerlens.llm._shared import Scratch, fresh

# between words, and after each character of scripts written without spaces
_BETWEEN = "(?<=[\\s\\x{2E80}-\\x{D7FF}\\x{F900}-\\x{FAFF}])(?=\\S)"
TREE = (
    "struct<root: string, pieces: array<int>, paragraphs: array<int>, paragraph_ends: array<int>, "
    "sections: array<int>, section_ends: array<int>>"
)


def _ends(items: Column, is_end: Callable[[Column], Column]) -> Column:
    """Numbers (from 1) of the items that end a run; the last one always does."""
    last = F.size(items) - 1
    return F.filter(F.transform(items, lambda x, i: F.when(is_end(x) | (i == last), i + 1)), lambda i: i.isNotNull())


def _runs(items: Column, ends: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make(run, last item)`` of every run of items."""

    def one(end: Column, k: Column) -> Column:
        before = F.coalesce(F.get(ends, k - 1), F.lit(0))
        return make(F.slice(items, before + 1, end - before), F.get(items, end - 1))

    return F.transform(ends, one)


def _node(level: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")), 256)


def _short(nodes: Column) -> Column:
    return F.transform(nodes, lambda h: F.shiftright(F.xxhash64(h), 32).cast("int"))


def fingerprints(
    docs: DataFrame, text: str = "text", name: str = "merkle", piece_words: int = 8, section_paragraphs: int = 4
) -> DataFrame:
    """``docs`` plus the tree of every text as a struct (``TREE``). A piece has
    ``piece_words`` words and a section ``section_paragraphs`` paragraphs on
    average. ``paragraph_ends`` counts pieces, ``section_ends`` paragraphs."""
    if piece_words < 1 or section_paragraphs < 1:
        raise ValueError("piece_words and section_paragraphs must be at least 1")
    names = iter([fresh(docs, f"_merkle{k}") for k in range(8)])
    d = docs

    def step(value: Column) -> Column:
        nonlocal d
        column = next(names)
        d = d.withColumn(column, value)
        return F.col(column)

    picked = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)) == 0
    line_end = lambda x: F.instr(x, "\n") > 0
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = step(F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _BETWEEN, -1)))
    piece_ends = step(_ends(words, lambda w: line_end(w) | picked(w, piece_words)))
    leaves = step(_runs(words, piece_ends, lambda run, last: F.struct(_node("leaf", run).alias("node"), line_end(last).alias("line"))))
    paragraph_ends = step(_ends(leaves, lambda x: x["line"]))
    leaves = step(F.transform(leaves, lambda x: x["node"]))
    paragraphs = step(_runs(leaves, paragraph_ends, lambda run, _: _node("paragraph", run)))
    section_ends = step(_ends(paragraphs, lambda x: picked(x, section_paragraphs)))
    sections = step(_runs(paragraphs, section_ends, lambda run, _: _node("section", run)))
    tree = F.struct(
        _node("root", sections).alias("root"), _short(leaves).alias("pieces"), _short(paragraphs).alias("paragraphs"),
        paragraph_ends.alias("paragraph_ends"), _short(sections).alias("sections"), section_ends.alias("section_ends"),
    )
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], tree.alias(name))


def to_text(tree: Column) -> Column:
    """A fingerprint as one string, equal for equal texts."""
    return F.to_json(tree)


def from_text(fingerprint: Column) -> Column:
    return F.from_json(fingerprint, TREE)


def likeness(a: Column, b: Column) -> Column:
    """Twice the common nodes over all nodes (leaves and root), 0 to 1. It is 1
    exactly when the roots are equal; a leaf that repeats in a text counts once."""
    common = F.size(F.array_intersect(a["pieces"], b["pieces"]))
    nodes = F.size(F.array_distinct(a["pieces"])) + F.size(F.array_distinct(b["pieces"])) + 2
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(2.0 * common / nodes)


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` that ``b`` does not have,
    found from the root down: nothing for equal roots, and only paragraphs of
    sections that ``b`` does not have are looked at."""
    sections = F.array_except(a["sections"], b["sections"])
    paragraphs = F.array_except(a["paragraphs"], b["paragraphs"])

    def inside(end: Column, k: Column) -> Column:
        before = F.coalesce(F.get(a["section_ends"], k - 1), F.lit(0))
        changed = F.array_contains(sections, F.get(a["sections"], k))
        return F.when(changed, F.sequence(before, end - 1)).otherwise(F.array().cast("array<int>"))

    looked_at = F.flatten(F.transform(a["section_ends"], inside))
    found = F.filter(looked_at, lambda i: F.array_contains(paragraphs, F.get(a["paragraphs"], i)))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(found)


def half_edits(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", block_rows: int = 64, **tree
) -> DataFrame:
    """Every row's text, its edited text and their trees: ``doc_id``, ``n_chars``,
    ``edited`` (the last half of the code points replaced by as many first ones,
    or all, of the next document), ``tree``, ``edited_tree``, ``next_tree`` and
    ``many`` (how many rows this one stands for).

    The next document is the next one by descending id, NULL last; after the
    last comes the first. Rows with one id are ordered by the SHA-256 of their
    text; of rows equal in both, each is followed by a copy of itself but one,
    which the next different row follows.

    Numbers of the rows are made from ids and digests (``number_rows``). Texts
    are shuffled twice: equal rows are made one, map-side first, and meet their
    numbers; then ``block_rows`` neighbours meet in a block, each with only the
    beginning that it or the row before it needs. The first row of a block also
    goes to the block before.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("t"))
    base = base.withColumn("key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.sha2("t", 256)))
    keys = base.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("t")).alias("n"), F.count(F.lit(1)).alias("copies"))
    rows = number_rows(keys.select("key", "doc_id", "n", "copies"), [F.col("doc_id").desc_nulls_last(), F.col("key").asc()])
    last = F.lit(max(rows.count(), 1)).cast("bigint")
    behind = rows.select((F.col("position") % last + 1).alias("after"), F.floor(F.col("n") / 2).cast("int").alias("wanted"))
    numbers = scratch.write(
        rows.join(behind, F.col("position") == F.col("after")).select(F.col("key").alias("k"), "position", "n", "copies", "wanted")
    )
    texts = base.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("t").alias("t"))
    d = fingerprints(texts.join(numbers, F.col("key") == F.col("k")), "t", "tree", **tree)

    n, here = F.col("n"), F.col("position")
    half = F.floor(n / 2).cast("int")
    before = F.when(here == 1, last).otherwise(here - 1)
    own = F.struct(here.alias("at"), F.lit(0).alias("extra"), F.greatest(n - half, F.col("wanted")).alias("size"))
    ahead = F.struct(before.alias("at"), F.lit(1).alias("extra"), F.col("wanted").alias("size"))
    d = d.withColumn("m", F.explode(F.when((here - 1) % block_rows == 0, F.array(own, ahead)).otherwise(F.array(own))))
    sent = d.select(
        "doc_id", "n", "copies", "tree", "m.at", "m.extra", F.left("t", F.col("m.size")).alias("body"),
        F.floor((F.col("m.at") - 1) / block_rows).alias("block"),
    )
    in_block = Window.partitionBy("block").orderBy("at", "extra")
    met = sent.select("*", F.lead("body").over(in_block).alias("tail"), F.lead("tree").over(in_block).alias("next_tree"))
    met = met.filter(F.col("extra") == 0)
    head = F.left("body", n - half)
    ends = F.struct(F.concat(head, F.left("tail", half)).alias("edited"), F.col("next_tree"), F.lit(1).cast("bigint").alias("many"))
    again = F.struct(F.concat(head, F.left("body", half)).alias("edited"), F.col("tree").alias("next_tree"), (F.col("copies") - 1).alias("many"))
    found = met.withColumn("found", F.explode(F.when(F.col("copies") > 1, F.array(ends, again)).otherwise(F.array(ends))))
    out = found.select("doc_id", n.cast("bigint").alias("n_chars"), "found.edited", "tree", "found.next_tree", "found.many")
    return fingerprints(out, "edited", "edited_tree", **tree)


def repeat_rows(df: DataFrame, many: str, step: int = 10_000) -> DataFrame:
    """Every row as often as ``many`` says, ``step`` at a time."""
    some, one = fresh(df, "_some"), fresh(df, "_one")
    d = df.withColumn(some, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(many) - 1) / step))))
    left = F.least(F.col(many) - F.col(some) * step, F.lit(step))
    return d.withColumn(one, F.explode(F.sequence(F.lit(1).cast("bigint"), left))).drop(some, one, many)
