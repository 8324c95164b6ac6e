"""Tables laid out for the reads they get: bucketed by id, by folder of account, and in ranges of date for pages at any depth."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.maintenance import sent_if_few

#: Bytes of raw messages in a bucket, rows of an account in a file, and rows of a range, about.
BUCKET_BYTES, ACCOUNT_ROWS, RANGE_ROWS = 512 << 20, 2_000_000, 1_000_000


# ---------------------------------------------------------------- by id: joins without a shuffle


def buckets_for(raw: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets the bodies ask for; envelopes take as many, so that both can be joined bucket by bucket."""
    return max(1, -(-(raw.agg(F.coalesce(F.sum(F.octet_length("eml")), F.lit(0))).first()[0]) // bucket_bytes))


def write_bucketed(rows: DataFrame, folder: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """A table bucketed and sorted by id, one file a bucket; its name in the session's catalogue is its own."""
    table = f"{name}_{uuid4().hex}"
    rows.repartition(buckets, "id").write.option("compression", "zstd").option("path", folder).bucketBy(buckets, "id").sortBy("id").saveAsTable(table)
    return rows.sparkSession.table(table)


def with_raw(envelopes: DataFrame, raw: DataFrame) -> DataFrame:
    """Envelopes and their bytes; of tables with equal buckets by id, neither moves. An id is of one account, so it alone joins them."""
    return envelopes.hint("merge").join(raw.select("id", "eml"), "id")


# ---------------------------------------------------------------- by account: scopes that prune folders


def write_by_account(rows: DataFrame, path: str, account_rows: int = ACCOUNT_ROWS) -> None:
    """A folder for each account; a large account is dealt over many files."""
    files = sent_if_few(rows.groupBy("account_id").agg(F.ceil(F.count("*") / account_rows).cast("int").alias("_files")))
    dealt = rows.join(files, "account_id").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))
    dealt.repartition("account_id", "_file").drop("_files", "_file").write.option("compression", "zstd").partitionBy("account_id").parquet(path)


def read_by_account(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


# ---------------------------------------------------------------- by date: pages at any depth


def write_ranges(rows: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Rows in the order of pages (date from young to old, then id), a folder for each range, and a table of how many rows stand before each."""
    ranges = max(1, -(-rows.count() // range_rows))
    order = [F.col("date").desc(), F.col("id").asc()]
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ordered.write.option("compression", "zstd").partitionBy("range").parquet(f"{path}/rows")
    counts = rows.sparkSession.read.schema("range int").parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n"))
    # A row for each range: as few as there are folders.
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    counts.select("range", "n", before.alias("before")).coalesce(1).write.parquet(f"{path}/ranges")


def page_of_ranges(spark: SparkSession, path: str, schema: StructType, number: int, size: int) -> DataFrame:
    """What search.page() gives for the page; the table of ranges tells which folders hold it, and only those are opened."""
    if number < 1 or size < 1:
        raise ValueError("page and size must be at least 1")
    first = (number - 1) * size
    ranges = spark.read.schema("range int, n bigint, before bigint").parquet(f"{path}/ranges")
    held = sorted((r["before"], r["range"]) for r in ranges.where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect())
    rows = spark.read.schema(StructType([*schema]).add("range", "integer")).parquet(f"{path}/rows").where(F.col("range").isin([k for _, k in held])).drop("range")
    return rows.orderBy(F.col("date").desc(), F.col("id").asc()).offset(first - held[0][0] if held else 0).limit(size)
