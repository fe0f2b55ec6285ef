"""Corpus pipeline: quality rules, near-duplicate removal, personal data,
source mixing, packing. Each stage works on all that its predecessor kept and
hands the columns of ``documents`` on; the last one returns the packing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm._shared import Scratch, fresh
from ledgerlens.llm.best_fit_packing import best_fit
from ledgerlens.llm.pii_bootstrap import mask, pattern_table
from ledgerlens.llm.quality_divergence import quality
from ledgerlens.llm.queries import MAX_REPEATS
from ledgerlens.llm.shingle_join import jaccard_components
from ledgerlens.llm.source_mixing import mix_sources


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The columns of ``docs`` travel in one
    struct, so none can clash with those of the rules. The row number keeps the
    optimizer from moving the filter below the features: the verdict would be
    computed there from the raw text, with every shared expression written out
    again. A NULL or empty text fails the base rules; rows that repeat an id are
    judged one by one; an empty table stays empty."""
    whole = docs.select("text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("stage_document"))
    judged = quality(whole).withColumn("stage_row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("stage_row") >= 0)).select("stage_document.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8
    or more) stays: the one of least id; of rows that repeat an id, one. Rows
    without an id stay."""
    scratch = Scratch(spark, "pipeline-near")
    found = jaccard_components(docs, scratch, n=5, percent=80)
    gone, n = fresh(docs, "gone_id"), fresh(docs, "row_no")
    lost = scratch.write(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct())
    kept = docs.join(lost, F.col("doc_id") == F.col(gone), "left_anti")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias(n)).filter((F.col(n) > 1) & F.col("doc_id").isNotNull())
    twice = scratch.write(twice.select(F.col("doc_id").alias(gone)))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, F.col("doc_id") == F.col(gone), "left_anti")
    again = kept.join(twice, F.col("doc_id") == F.col(gone), "left_semi")
    # the least row of an id by all columns: combined map-side, however often it comes
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = again.groupBy(F.col("doc_id").alias(gone)).agg(F.min(F.struct(*columns)).alias(n))
    return once.unionByName(least.select(f"{n}.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets. NULL and empty texts
    and rows that repeat an id stay as they are; an empty table stays empty."""
    return mask(docs, pattern_table(docs, Scratch(spark, "pipeline-pii"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights say, at least once. A NULL
    source is a source; texts without tokens and an empty table pass once."""
    return mix_sources(docs, Scratch(spark, "pipeline-mix"), max_repeats=MAX_REPEATS).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as pieces of bins. NULL and empty texts have none; rows that repeat
    an id are packed one by one; an empty table gives no bins."""
    return best_fit(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    df = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES[:-1]:
        df = scratch.write(stage(spark, df, sf_dir))
    return STAGES[-1][1](spark, df, sf_dir)


# The learned references and patterns of two stages have no SQL form; the
# stages are tested against brute-force versions instead.
ORACLE_SQL = None
