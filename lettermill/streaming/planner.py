"""Incremental ingest as one stateful stream: for each folder its validity epoch, its highest uid and when it may be read again.

Two streams meet by (account, folder): reports of folders, as a server lists them, and messages in a landing folder. Only what
decides goes through the state (uid, date, file), never a body: a batch's decisions name the files to read. State lives in
the state store, so a restart goes on where it was, and messages that come twice lie under the high-water mark.

A report gives a plan: create or load for a new folder, incremental for the known epoch, rebuild for another one (which
forgets the mark), skip where the server gives none; while a folder is skipped, its messages wait for the next listing. A
message above the mark, and older than before where that is set, is fetched. After a load a folder rests for
cool_down_ms, after other reads for interval_ms: what comes meanwhile is held, and a timer lets it go. Folders
without a report are not chosen, and none of their messages is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.columns import scoped_id
from ..operators import folders
from ..operators.ingest import COOL_DOWN_MS
from .ingest import ENVELOPE_FILES, landed, landing, write_batch

REPORTS = "account_id bigint, mailbox string, uid_validity bigint, exists bigint, seq bigint"
DECISIONS = "account_id bigint, mailbox string, action string, uid bigint, seq bigint, path string"
_STATE = "validity bigint, high bigint, rest_until bigint, skipped boolean, since bigint"
_HELD = "uid bigint, seq bigint, path string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FolderPlan(StatefulProcessor):
    """Decisions for one (account, folder) from its reports and messages, in the order of seq."""

    def __init__(self, before: int | None, cool_down_ms: int, interval_ms: int):
        self.before, self.cool_down_ms, self.interval_ms = before, cool_down_ms, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folder = handle.getValueState("folder", _STATE)
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        state = self.folder.get()
        validity, high, rest, skipped, since = tuple(state) if state else (None, -1, 0, True, 0)
        known, resting, mark, seen = state is not None, rest > now, high, set()
        read = None
        # Reports and places of messages of one batch, which is as large as the files of a trigger.
        for row in sorted(rows, key=lambda r: (r["seq"], r["is_message"])):
            if row["is_message"]:
                if skipped or row["seq"] < since or row["uid"] <= mark or row["uid"] in seen or self.before is not None and row["date"] >= self.before:
                    continue
                seen.add(row["uid"])
                if resting:
                    self.held.appendValue((row["uid"], row["seq"], row["path"]))
                    continue
                read, high = read or "incremental", max(high, row["uid"])
                yield self._decision(key, "fetch", row["uid"], row["seq"], row["path"])
                continue
            action = _action(known, validity, row)
            if action == "rebuild":
                # Another epoch: uids begin anew, and what is held or older than the report is of the old one.
                mark, high, resting, since = -1, -1, False, row["seq"]
                seen.clear()
                self.held.clear()
            read = action if action in ("load", "rebuild") else read
            known, skipped = True, action == "skip"
            validity = validity if skipped else row["uid_validity"]
            yield self._decision(key, action, None, row["seq"], None)
        if resting and seen:
            self.handle.registerTimer(rest)
        elif read:
            rest = now + (self.interval_ms if read == "incremental" else self.cool_down_ms)
        if known:
            self.folder.update((validity, high, rest, skipped, since))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What came while the folder rested."""
        validity, high, _, skipped, since = tuple(self.folder.get())
        held = sorted({row[0]: tuple(row) for row in self.held.get() if row[0] > high}.values())
        self.held.clear()
        for uid, seq, path in held:
            yield self._decision(key, "fetch", uid, seq, path)
        if held:
            self.folder.update((validity, held[-1][0], timerValues.getCurrentProcessingTimeInMs() + self.interval_ms, skipped, since))

    def _decision(self, key, action: str, uid: int | None, seq: int | None, path: str | None) -> Row:
        return Row(account_id=key[0], mailbox=key[1], action=action, uid=uid, seq=seq, path=path)

    def close(self) -> None:
        pass


def _action(known: bool, validity: int | None, report: Row) -> str:
    if not known:
        return "load" if report["exists"] else "create"
    if report["uid_validity"] is None:
        return "skip"
    return "incremental" if report["uid_validity"] == validity else "rebuild"


def reports(remote: DataFrame, seq: int) -> DataFrame:
    """Rows of a listing (account_id, name, flag, subscribed, uid_validity, exists) as reports: of the folders that are to be read, see folders.selected()."""
    return folders.selected(remote).select("account_id", F.col("name").alias("mailbox"), "uid_validity", "exists", F.lit(seq).cast("bigint").alias("seq"))


def decisions(messages: DataFrame, listed: DataFrame, before: int | None = None, cool_down_ms: int = COOL_DOWN_MS, interval_ms: int = 0) -> DataFrame:
    """DECISIONS of two streams: messages (account_id, mailbox, uid, internal_date, seq, path) and listed (REPORTS)."""
    none = lambda kind: F.lit(None).cast(kind)
    a = listed.select("account_id", "mailbox", F.lit(False).alias("is_message"), "uid_validity", "exists", none("bigint").alias("uid"), none("bigint").alias("date"), "seq", none("string").alias("path"))
    b = messages.select("account_id", "mailbox", F.lit(True).alias("is_message"), none("bigint").alias("uid_validity"), none("bigint").alias("exists"), "uid", F.col("internal_date").alias("date"), "seq", "path")
    return a.unionByName(b).groupBy("account_id", "mailbox").transformWithState(FolderPlan(before, cool_down_ms, interval_ms), DECISIONS, "append", "ProcessingTime")


def write_decisions(rows: DataFrame, batch_id: int, root: str) -> None:
    """The chosen messages of a batch, and a deletion for each folder that is rebuilt, in the logs; the decisions in a log of their own.

    Only the files that the decisions name are opened: no more of them than a trigger takes.
    """
    spark = rows.sparkSession
    path = f"{root}/decisions/batch={batch_id}"
    rows.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(DECISIONS).parquet(path)
    chosen = rows.where("action = 'fetch'").select("account_id", "mailbox", "uid", "seq")
    files = [r[0] for r in rows.where("path is not null").select("path").distinct().collect()]
    found = landed(spark, *files) if files else spark.createDataFrame([], landed(spark).schema)
    rebuilt = rows.where("action = 'rebuild'").select("account_id", scoped_id(F.col("account_id"), F.col("mailbox")).alias("mailbox_id"), "seq", F.lit("delete_mailbox").alias("op"))
    write_batch(found.join(chosen, ["account_id", "mailbox", "uid", "seq"], "left_semi"), batch_id, root, rebuilt)


def run(spark: SparkSession, source: str, listings: str, root: str, every: str | None = None, before: int | None = None, cool_down_ms: int = COOL_DOWN_MS, interval_ms: int = 0) -> StreamingQuery:
    """Reads both folders to their ends, or goes on at an interval such as '30 seconds'; timers then run out without new files too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    # A plan with timers asks for one more batch after each; one that reads to the end would never end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(every is not None).lower())
    messages = landing(spark, source).select("account_id", "mailbox", "uid", "internal_date", "seq", F.col("_metadata.file_path").alias("path"))
    listed = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", ENVELOPE_FILES).parquet(listings)
    writer = decisions(messages, listed, before, cool_down_ms, interval_ms).writeStream.foreachBatch(lambda b, i: write_decisions(b, i, root)).option("checkpointLocation", f"{root}/checkpoint")
    try:
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def decided(spark: SparkSession, root: str) -> DataFrame:
    """All decisions so far."""
    return spark.read.schema(DECISIONS + ", batch bigint").parquet(f"{root}/decisions")
