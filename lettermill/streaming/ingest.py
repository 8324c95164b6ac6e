"""Streams: a landing folder of raw messages into envelope and raw logs, live counts, and the last errors of each account.

A batch is written under its id into folders of its own that a repeated batch overwrites, so replays change nothing. It
counts once its marker is written, last; readers follow the markers, so none sees half a batch. Spark retries tasks; nothing
here does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.columns import scoped_id
from ..operators import ingest as planning
from ..operators.ingest import ERRORS_KEPT
from ..operators.maintenance import latest
from ..schemas import ENVELOPES, LANDING, RAW
from ..sources import eml

ENVELOPE_FILES = 20
#: Columns of the logs; batch is the folder.
LOGS = {"envelopes": f"{ENVELOPES}, seq bigint, op string, batch bigint", "raw": f"{RAW}, seq bigint, op string, batch bigint", "quarantine": "index bigint, error_message string, batch bigint"}


def landing(spark: SparkSession, path: str, files: int = ENVELOPE_FILES) -> DataFrame:
    return spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files).parquet(path)


def landed(spark: SparkSession, *paths: str) -> DataFrame:
    """The same folder, or files of it, read as a batch."""
    return spark.read.schema(LANDING).parquet(*paths) if paths else spark.createDataFrame([], LANDING)


def pulled(rows: DataFrame) -> DataFrame:
    """Envelope rows, with errors, of landed messages."""
    return eml.envelopes(rows.withColumn("key", F.col("seq")).withColumnRenamed("body", "eml"), imported=False)


def planned(rows: DataFrame, accounts: DataFrame, state: DataFrame, high: DataFrame, now: int) -> DataFrame:
    """The landed rows to take now: of enabled accounts that are due, and of each folder what lies above its highest uid.

    high: account_id, mailbox_id, max_uid. Of an account without state all rows are taken.
    """
    due = planning.run_action(accounts, state, now).where("action <> 'skip'").select(F.col("id").alias("account_id"), "action")
    mine = rows.join(due, "account_id").withColumn("mailbox_id", scoped_id(F.col("account_id"), F.col("mailbox"))).join(high, ["account_id", "mailbox_id"], "left")
    return mine.where((F.col("action") == "initial") | (F.col("uid") > F.coalesce("max_uid", F.lit(-1)))).drop("action", "mailbox_id", "max_uid")


def write_batch(batch: DataFrame, batch_id: int, root: str, more: DataFrame | None = None) -> None:
    """The last version of each message of the batch in both logs, failures in the quarantine, and then the marker.

    more: further ops for both logs, such as deletions of folders that are read anew.
    """
    rows = pulled(batch).persist()
    try:
        good, bad = eml.split_errors(rows)
        last = latest(good).withColumn("op", F.lit("upsert"))
        for name, part in (("envelopes", last.drop("eml", "key")), ("raw", last.select("id", "account_id", "mailbox_id", "eml", "seq", "op")), ("quarantine", bad)):
            if more is not None and name != "quarantine":
                part = part.unionByName(more, allowMissingColumns=True)
            part.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/batch={batch_id}")
        batch.sparkSession.range(1).select(F.lit(batch_id).cast("bigint").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{root}/done/marker={batch_id}")
    finally:
        rows.unpersist()


def written(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The log of that name (envelopes, raw or quarantine), of batches that are complete.

    A filter on batch reaches the folders of both the log and the markers, so what is read after a snapshot is young batches only.
    """
    done = spark.read.schema("batch bigint, marker bigint").parquet(f"{root}/done").where("batch = marker").select(F.col("marker").alias("batch")).distinct()
    return spark.read.schema(LOGS[name]).parquet(f"{root}/{name}").join(done, "batch", "left_semi")


def once(rows: DataFrame, replays: str) -> DataFrame:
    """Landed messages without those that came before, in another file or batch, within such a time; what is kept in state is bounded by it."""
    arrived = rows.withColumn("_arrived", F.col("_metadata.file_modification_time")).withWatermark("_arrived", replays)
    return arrived.dropDuplicatesWithinWatermark(["account_id", "mailbox", "uid", "seq"]).drop("_arrived")


def run(spark: SparkSession, source: str, root: str, every: str | None = None, plan: Callable[[DataFrame], DataFrame] | None = None, replays: str | None = None) -> StreamingQuery:
    """Reads the landing folder to its end, or goes on at an interval such as '30 seconds'; plan picks the rows of a batch, as planned() does.

    replays: how long after it first came a message may come again, such as '7 days'; then it is written once.
    """
    pick = plan or (lambda rows: rows)
    rows = landing(spark, source)
    writer = (once(rows, replays) if replays else rows).writeStream.foreachBatch(lambda b, i: write_batch(pick(b), i, root)).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _last_errors(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState, kept: int) -> Iterator[pd.DataFrame]:
    held = list(zip(*state.get)) if state.exists else []
    for part in rows:
        held += list(zip(part["at"].tolist(), part["error"].tolist()))
    held = sorted(held)[-kept:]
    state.update(tuple(map(list, zip(*held))))
    yield pd.DataFrame({"account_id": key[0], "at": [[int(a) for a, _ in held]], "error": [[e for _, e in held]]})


def error_state(stream: DataFrame, kept: int = ERRORS_KEPT) -> DataFrame:
    """The last errors of each account after each batch of a stream (account_id, error, at), as lists from old to new."""
    lists = "at array<bigint>, error array<string>"
    return stream.groupBy("account_id").applyInPandasWithState(partial(_last_errors, kept=kept), f"account_id bigint, {lists}", lists, "update", "NoTimeout")


def live_activity(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages of each day of a stream with a time date_ts; days close once the watermark has passed them."""
    return stream.withWatermark("date_ts", late).groupBy(F.window("date_ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")
