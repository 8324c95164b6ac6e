"""Where jobs keep tables between their steps, and small helpers on sessions."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a new one where it is unset and all tasks run on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once as a table in the shared folder; what reads it survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Rows of a few bytes each that may go to every task.
SMALL_ROWS = 1 << 19


def small(frame: DataFrame) -> DataFrame:
    """A kept table of keys: broadcast if it has SMALL_ROWS rows at most, else joined by a shuffle."""
    return F.broadcast(frame) if frame.count() <= SMALL_ROWS else frame


def share_of(column: str, share: float) -> Column:
    """True for about this share of the values of a column, by all 64 bits of a hash, so that a small share of many is met as well."""
    return F.xxhash64(column) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))


def most_frequent(counts: DataFrame, word: str, n: str, most: int) -> Column:
    """True for at most about so many rows of counts, a row for each word: those of the largest n, and a share of those where they end.

    Counts from 2 ** 16 on are told apart by steps of one in a hundred, so what comes to the driver is bounded.
    """
    step = F.when(F.col(n) < 1 << 16, F.col(n).cast("bigint")).otherwise((1 << 16) + F.floor(64 * (F.log2(n) - 16)))
    held, least, share = 0, 0, 1.0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        if held + row["words"] > most:
            least, share = row["step"], (most - held) / row["words"]
            break
        held += row["words"]
    return (step > least) | (step == least) & share_of(word, share) & F.lit(share > 0)


def quoted(name: str) -> str:
    """A column's name as an expression, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def row_of(frame: DataFrame) -> Column:
    """All columns of a row as one, named row."""
    return F.struct(*[F.col(quoted(c)) for c in frame.columns]).alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
