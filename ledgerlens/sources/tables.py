"""Readers and writers for the ``customer_transactions`` table.

* Parquet — the native layout (columnar, filter and column pushdown).
* CSV — the reference's load format: header row, ISO timestamps,
  ``true``/``false``, empty field = NULL; always read with the fixed
  schema (never inferred) and FAILFAST, so a bad row fails the load.
* JDBC — the reference's live table, read in parallel slices of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ledgerlens.schema import CT_SCHEMA, conform

CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


# Directory column of the stored layout: the location behind a prefix, since a
# directory without text would be read back as NULL.
LOCATION_DIR = "location_dir"
_DIR_PREFIX = "_"

# Parquet Bloom filters on the customer key, sized by the customers of each
# row group (so small files get small filters).
_KEY_FILTERS = {
    "parquet.bloom.filter.enabled#cid": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.candidates.number#cid": "8",
}


def read_transactions_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table with the fixed schema (column order and types). In the
    stored layout the location comes from the directory, so a filter on it
    prunes directories."""
    if LOCATION_DIR not in spark.read.parquet(path).columns:
        return conform(spark.read.schema(CT_SCHEMA).parquet(path))
    stored = StructType([f for f in CT_SCHEMA.fields if f.name != "purchaselocation"]).add(LOCATION_DIR, StringType())
    df = spark.read.schema(stored).parquet(path)
    return conform(df.withColumn("purchaselocation", F.substring(LOCATION_DIR, len(_DIR_PREFIX) + 1, 2**31 - 1)))


def read_transactions_csv(spark: SparkSession, path: str, timestamp_format: str = CSV_TIMESTAMP_FORMAT) -> DataFrame:
    """CSV file(s) with a header row. Columns are found by their header names,
    in any order, and parsed with the types of ``CT_SCHEMA``; a missing or
    unknown column, or a file with another header, fails the load.

    Files are split by Spark across tasks (plain, uncompressed CSV is
    splittable), so one large file still loads in parallel.
    """
    header = spark.read.option("header", True).csv(path).columns
    if sorted(header) != sorted(CT_SCHEMA.names):
        raise ValueError(f"CSV header {header} does not have the columns {CT_SCHEMA.names}")
    return conform(
        spark.read.schema(StructType([CT_SCHEMA[c] for c in header]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", timestamp_format)
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def write_transactions_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", timestamp_format: str = CSV_TIMESTAMP_FORMAT
) -> None:
    """The table in the layout of :func:`read_transactions_csv`: a header row in
    every file, the schema's columns, ISO timestamps with microseconds where
    they have any, NULL as an empty field (so an empty text comes back as NULL)."""
    (
        conform(df)
        .write.mode(mode)
        .option("header", True)
        .option("timestampNTZFormat", timestamp_format)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)  # the writer trims otherwise
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def jdbc_options(
    url: str,
    table: str = "customer_transactions",
    *,
    lower_bound: int,
    upper_bound: int,
    num_partitions: int,
    partition_column: str = "tid",
    fetch_size: int = 10_000,
    **extra,
) -> dict[str, str]:
    """Options for a parallel JDBC read: ``num_partitions`` range slices
    of ``partition_column`` between the bounds (rows outside the bounds
    still go to the first/last slice; the bounds only shape the split).
    Credentials are passed by the caller in ``extra`` (``user``,
    ``password``, ``driver``); none are defaulted here."""
    if num_partitions < 1:
        raise ValueError("num_partitions must be >= 1")
    if upper_bound < lower_bound:
        raise ValueError("upper_bound must be >= lower_bound")
    opts = {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower_bound),
        "upperBound": str(upper_bound),
        "numPartitions": str(num_partitions),
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",  # the columns carry no zone
    }
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def key_slices_query(table: str, num_partitions: int) -> str:
    """First key of each of ``num_partitions`` slices with equally many rows,
    in key order: ``(cid, tid)`` is the table's only index."""
    return (
        "SELECT cid, tid FROM (SELECT cid, tid, slice, ROW_NUMBER() OVER (PARTITION BY slice ORDER BY cid, tid) AS place "
        f"FROM (SELECT cid, tid, NTILE({num_partitions}) OVER (ORDER BY cid, tid) AS slice FROM {table}) s) t "
        "WHERE place = 1 AND slice > 1 ORDER BY cid, tid"
    )


def slice_predicates(starts: list[tuple[int, int]]) -> list[str]:
    """One condition per slice; together they hold every row once. A customer
    with very many rows is split on ``tid``."""
    if not starts:
        return ["1 = 1"]
    # the plain bounds on cid let the database use its index
    since = [f"cid >= {c} AND (cid > {c} OR tid >= {t})" for c, t in starts]
    until = [f"cid <= {c} AND (cid < {c} OR tid < {t})" for c, t in starts]
    whole = "cid IS NOT NULL AND tid IS NOT NULL"  # a NULL key is in the first slice only
    middle = [f"{lo} AND {hi} AND {whole}" for lo, hi in zip(since, until[1:], strict=False)]
    return [f"({until[0]}) OR cid IS NULL OR tid IS NULL", *middle, f"{since[-1]} AND {whole}"]


def read_transactions_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "customer_transactions",
    *,
    num_partitions: int,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    partition_column: str = "tid",
    **extra,
) -> DataFrame:
    """Read the table over JDBC in ``num_partitions`` parallel slices. Without
    bounds, the database is asked for slices of equally many rows along its
    ``(cid, tid)`` index (``num_partitions`` - 1 keys come back); with bounds,
    slices are ranges of ``partition_column``. Filters and the column list of
    later operators are pushed into the remote query."""
    if num_partitions < 1:
        raise ValueError("num_partitions must be >= 1")
    if lower_bound is None or upper_bound is None:
        options = {"preferTimestampNTZ": "true", **{k: str(v) for k, v in extra.items()}}
        keys = spark.read.format("jdbc").options(url=url, query=key_slices_query(table, num_partitions), **options).load()
        starts = [(int(r["cid"]), int(r["tid"])) for r in keys.collect()] if num_partitions > 1 else []
        return conform(spark.read.jdbc(url, table, predicates=slice_predicates(starts), properties={"fetchsize": "10000", **options}))
    opts = jdbc_options(
        url,
        table,
        lower_bound=lower_bound,
        upper_bound=upper_bound,
        num_partitions=num_partitions,
        partition_column=partition_column,
        **extra,
    )
    return conform(spark.read.format("jdbc").options(**opts).load())


def write_transactions(df: DataFrame, path: str, mode: str = "errorifexists", num_files: int | None = None) -> None:
    """Write the table as Parquet in the layout the queries want.

    * ``num_files=n`` (the layout for a stored table): one directory per
      location (``partitionBy("location_dir")``, the location behind a
      prefix; an empty location stays apart from NULL), so a per-state query
      reads only its directory (an exact partition filter). Inside, rows
      are range-partitioned into ``n`` tasks on (location, ``cid``, ``tid``)
      and sorted the same way, so each file covers a narrow range of
      customers: the customer-keyed queries (loyalty, customer summary) then
      collapse a customer's rows in the partial aggregate before the
      shuffle, which carries about one row per customer and file instead
      of one per transaction. A location or a customer holding a third of
      the rows is still split, on ``cid`` and on the unique ``tid``. One
      sampling job and one shuffle, paid once when the table is written.
      Every row group also gets a Bloom filter of its customers, so a lookup
      of one ``cid`` skips the row groups that do not hold it although it lies
      between their least and greatest ``cid``.
    * ``num_files=None``: keep the input's partitioning (no shuffle, no
      directories — unclustered input would scatter small files over every
      location); each task sorts its own rows the same way, so row groups
      are still clustered by location within a file.
    """
    out = conform(df)
    keys = [
        F.col("purchaselocation").asc_nulls_last(),
        F.col("cid").asc_nulls_last(),
        F.col("tid").asc_nulls_last(),
    ]
    if num_files is None:
        out.sortWithinPartitions(*keys).write.mode(mode).parquet(path)
        return
    if num_files < 1:
        raise ValueError("num_files must be >= 1")
    (
        out.repartitionByRange(num_files, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(LOCATION_DIR, F.concat(F.lit(_DIR_PREFIX), "purchaselocation"))
        .drop("purchaselocation")
        .write.mode(mode)
        .options(**_KEY_FILTERS)
        .partitionBy(LOCATION_DIR)
        .parquet(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result rows as JSON lines, one object per row (the reference's
    response body shape). Decimals are written as JSON numbers; a NULL field
    keeps its key."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object string in column ``value``; stays a
    distributed DataFrame (nothing is collected)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
