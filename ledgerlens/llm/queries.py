"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm._shared import Scratch
from ledgerlens.llm.best_fit_packing import best_fit
from ledgerlens.llm.fill_in_middle import fill_in_middle, restore
from ledgerlens.llm.lm_scoring import stupid_backoff
from ledgerlens.llm.merkle_fingerprints import half_edits, likeness, repeat_rows, to_text
from ledgerlens.llm.pii_bootstrap import find_spans, pattern_table
from ledgerlens.llm.pstable_dedup import near_vectors
from ledgerlens.llm.quality_divergence import quality
from ledgerlens.llm.shingle_join import jaccard_components
from ledgerlens.llm.source_audit import source_audit
from ledgerlens.llm.source_mixing import mix_sources, token_count
from ledgerlens.llm.suffix_dedup import repeated_passages
from ledgerlens.llm.toxicity_segments import fit, toxicity
from ledgerlens.llm.url_filters import parse_rules, url_verdicts

# The rules of the URL query.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
MAX_REPEATS = 2.0


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality(_read(spark, sf_dir, "documents"))
    return q.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"), Scratch(spark, "op2"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    mixed = mix_sources(docs, Scratch(spark, "op3"), max_repeats=MAX_REPEATS)
    return mixed.select("doc_id", "source", token_count(mixed["text"]).alias("n_tokens"), "mix_epoch", "mix_block", "mix_place")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(_read(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(parse_rules(RULES), "host string, path string, verdict string")
    return url_verdicts(_read(spark, sf_dir, "pages"), rules)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return find_spans(docs, pattern_table(docs, Scratch(spark, "op7")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(_read(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), Scratch(spark, "op9"), n=4, percent=85)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"), Scratch(spark, "op10"), length=50)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformed texts as digests, and the digests of the texts that are
    put together from them again."""
    d = fill_in_middle(_read(spark, sf_dir, "documents"), rate=50, spm_rate=80, seed=42)
    return d.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(restore(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = half_edits(_read(spark, sf_dir, "documents"), Scratch(spark, "op12"))
    digests = d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        to_text(F.col("tree")).alias("fingerprint"), to_text(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"), likeness(F.col("tree"), F.col("next_tree")).alias("near_next"), "many",
    )
    return repeat_rows(digests, "many")


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(_read(spark, sf_dir, "documents"), Scratch(spark, "op13"), min_docs=30, top=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_quality_rules, op2_embedding_near_dedup, op3_source_mixing, op4_toxicity, op5_lm_scoring,
        op6_url_filters, op7_pii, op8_best_fit_packing, op9_ngram_jaccard_join, op10_suffix_array_dedup,
        op11_fill_in_middle, op12_document_fingerprints, op13_source_divergence_audit,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the query. Counts that can be NULL are
    DOUBLE there: that is what a nullable bigint of Spark becomes in pandas."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in parse_rules(RULES))
    return {
        "op6_url_filters": f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(COALESCE(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(r_host, r_path, r_verdict) AS (VALUES {rules}),
hit AS (
  SELECT p.*, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_verdict DESC) AS k
  FROM p LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, COALESCE(r_verdict, 'allow') AS verdict FROM hit WHERE k = 1""",
        "op11_fill_in_middle": r"""
WITH u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h
  FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)),
h AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM u),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
part AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS DOUBLE) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS DOUBLE) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM part""",
        "op13_source_divergence_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, COALESCE(text, '') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d),
c AS (
  SELECT lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term,
    COUNT(*) AS n, COUNT(DISTINCT rid) AS df
  FROM w GROUP BY ALL),
k AS (SELECT lang, term, SUM(n) AS n FROM c GROUP BY lang, term HAVING SUM(df) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT g.lang, COUNT(k.term) AS v, COALESCE(SUM(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k ON g.lang = k.lang GROUP BY g.lang),
x AS (
  SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n, k.n AS lang_n,
    SUM(COALESCE(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT x.lang, x.source, x.term, x.n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (x.n + 5) // (x.total + 5 * l.v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (x.lang_n + 5) // (l.total + 5 * l.v) AS BIGINT) AS q
  FROM x JOIN l ON l.lang = x.lang),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(SUM(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
    }
