"""URL filters by hashed host-suffix / path-prefix expressions.

Every URL is expanded into the expressions (host suffix + path prefix) that a
rule could have; expressions and rules meet in an equi-join on a short prefix
of their SHA-256, the full digests confirm the match, and the longest rule
wins. Only DataFrame functions run.

Defined cases: NULL url or one without ``://`` has empty host and path and
fits only a rule with an empty host; NULL page ids are kept; repeated rows are
judged and returned once each; an empty page or rule table works; other
columns of ``pages`` are ignored. Equally long rules: the one with the longer
host, then ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """Host suffixes with a rule's number of labels, times path prefixes with a
    rule's length: every rule that fits is among them."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    counts = F.filter(F.array(*[F.lit(x) for x in label_counts]), lambda k: k <= n)
    lengths = F.filter(F.array(*[F.lit(x) for x in path_lengths]), lambda k: k <= F.length(path))
    suffixes = F.transform(counts, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda k: F.concat(s, F.substring(path, F.lit(1), k)))))


def url_verdicts(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
    prefix_hex: int = PREFIX_HEX, default: str = "allow",
) -> DataFrame:
    """``rules`` (host, path, verdict) -> one row per row of ``pages``:
    page_id, host, path, rule, verdict.

    The rule table is joined, never collected; only its distinct label counts
    and path lengths (two short lists of integers) steer the expansion. Spark
    broadcasts the rules if their size allows it and shuffles both sides on
    the digest prefix otherwise.
    """
    r = rules.select(
        F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER).alias("r_host"),
        F.coalesce(F.col("path"), F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).withColumn("rule", F.concat("r_host", "r_path"))
    shape = r.agg(
        F.sort_array(F.collect_set(F.size(F.split("r_host", "\\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()
    digest = F.sha2(F.col("rule").cast("binary"), 256)
    r = r.distinct().select("rule", F.length("r_host").alias("r_len"), "r_verdict", digest.alias("r_digest"), F.substring(digest, 1, prefix_hex).alias("r_prefix"))
    # of the rules of one prefix, the first in digest order counts rows
    same = Window.partitionBy("r_prefix").orderBy("r_digest", "r_len", "r_verdict")
    r = r.withColumn("r_first", F.row_number().over(same) == 1)

    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    p = p.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if shape.labels:
        expr = _expressions(F.col("host"), F.col("path"), shape.labels, shape.lengths)
    else:
        expr = F.array().cast("array<string>")
    e = p.select("page_id", "url", "host", "path", F.posexplode_outer(expr).alias("pos", "expr"))
    e = e.withColumn("digest", F.sha2(F.col("expr").cast("binary"), 256)).withColumn("prefix", F.substring("digest", 1, prefix_hex))
    hit = e.join(r, F.col("prefix") == F.col("r_prefix"), "left")
    confirmed = F.when(
        F.col("digest") == F.col("r_digest"),
        F.struct(F.length("rule").alias("len"), F.col("r_len"), F.col("r_verdict"), F.col("rule")),
    )
    best = _best(hit, confirmed)
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
    )


def _best(hit: DataFrame, confirmed: Column) -> DataFrame:
    """One row per (page, url); repeated rows are counted at their first
    expression and come back as many times. A prefix shared by rules repeats a
    row, so the count looks at one rule per expression."""
    first = (F.coalesce(F.col("pos"), F.lit(0)) == 0) & F.coalesce(F.col("r_first"), F.lit(True))
    g = hit.groupBy("page_id", "url", "host", "path").agg(
        F.max(confirmed).alias("best"), F.sum(F.when(first, 1).otherwise(0)).alias("n")
    )
    return g.select("page_id", "url", "host", "path", "best", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))


def parse_rules(rows: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """('allow', 'com/') -> (host, path, verdict)."""
    out = []
    for verdict, rule in rows:
        host, slash, path = rule.partition("/")
        out.append((host, slash + path, verdict))
    return out
