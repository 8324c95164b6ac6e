"""Dashboard numbers kept in step with writes, by retraction: a changed message takes its old row out and puts its new one in.

A keyed stream holds, for each message, what its last version adds to the numbers, and emits it with a sign: -1 for the row that was
there, +1 for the one that is there now. Signed rows of a batch sum to one row for each number that moved, and these are
appended under the batch's id, so a batch that comes again overwrites itself. Sums over all of them are the numbers of the living rows:
counts, sizes, attachments, days, senders, accounts, and tags with all levels above them. Only the batch's rows and the states of its ids are
read, never the archive.

Deletions of folders and accounts name no ids; by_id() writes them out for the ids that they hit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.columns import DAY_MS, path_prefixes
from ..operators.aggregates import ACTIVITY_DAYS, TOP, day
from ..operators.maintenance import sent_if_few

CHANGES = "op string, seq bigint, id bigint, account_id bigint, mailbox_id bigint, `from` string, date bigint, size bigint, has_attachment boolean, tags array<string>"
SIGNED = "sign int, id bigint, account_id bigint, `from` string, date bigint, size bigint, has_attachment boolean, tags array<string>"
NUMBERS = "part string, key string, n bigint"
_FACTS = ("account_id", "from", "date", "size", "has_attachment", "tags")
_STATE = "seq bigint, account_id bigint, `from` string, date bigint, size bigint, has_attachment boolean, tags array<string>, tag_seq bigint, new_tags array<string>, ended bigint"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastVersion(StatefulProcessor):
    """The last upsert, tags and deletion of one id, whatever the order in which they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        seq, *facts, tag_seq, new_tags, ended = tuple(held) if held else (-1, *[None] * 6, -1, None, -1)
        before = _living(seq, facts, tag_seq, new_tags, ended)
        for row in rows:
            if row["op"] == "upsert" and row["seq"] > seq:
                seq, facts = row["seq"], [row[c] for c in _FACTS]
            elif row["op"] == "delete":
                ended = max(ended, row["seq"])
            elif row["op"] == "tags" and row["seq"] > tag_seq:
                tag_seq, new_tags = row["seq"], row["tags"]
        self.state.update((seq, *facts, tag_seq, new_tags, ended))
        after = _living(seq, facts, tag_seq, new_tags, ended)
        if before != after:
            for sign, now in ((-1, before), (1, after)):
                if now is not None:
                    yield Row("sign", "id", *_FACTS)(sign, key[0], *now)

    def close(self) -> None:
        pass


def _living(seq: int, facts: list, tag_seq: int, new_tags: list | None, ended: int) -> tuple | None:
    """What a message adds: nothing if it never came or ended; tags of the log of tags outlive its versions."""
    if seq < 0 or ended >= seq:
        return None
    return (*facts[:-1], list(new_tags if tag_seq >= 0 else facts[-1] or []))


def by_id(changes: DataFrame, living: DataFrame) -> DataFrame:
    """Changes of single ids: deletions of folders and accounts written out for the living rows (id, account_id, mailbox_id) and the batch's own.

    For the rows of one batch; living is narrow, and few deletions go to it.
    """
    single = changes.where("op not in ('delete_mailbox', 'delete_account')")
    known = living.select("id", "account_id", "mailbox_id").union(changes.where("op = 'upsert'").select("id", "account_id", "mailbox_id")).distinct()
    box = sent_if_few(changes.where("op = 'delete_mailbox'").groupBy("account_id", "mailbox_id").agg(F.max("seq").alias("seq")))
    account = sent_if_few(changes.where("op = 'delete_account'").groupBy("account_id").agg(F.max("seq").alias("seq")))
    hit = known.join(box, ["account_id", "mailbox_id"]).select("id", "seq").union(known.join(account, "account_id").select("id", "seq"))
    return single.unionByName(hit.withColumn("op", F.lit("delete")), allowMissingColumns=True)


def signed(changes: DataFrame) -> DataFrame:
    """SIGNED rows of a stream of changes by id (CHANGES; op upsert, delete or tags)."""
    return changes.groupBy("id").transformWithState(LastVersion(), SIGNED, "append", "None")


def moved(rows: DataFrame) -> DataFrame:
    """What signed rows move: (part, key, n) of each number that is not as before."""
    number = lambda part, key, n: F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), (F.col("sign") * n).cast("bigint").alias("n"))
    none, has = F.lit(""), F.coalesce("has_attachment", F.lit(False))
    one = F.array(
        number("count", none, F.lit(1)), number("size", none, F.coalesce("size", F.lit(0))), number("with_attachment", none, has.cast("int")), number("without_attachment", none, (~has).cast("int")),
        number("activity", day(F.col("date")), F.lit(1)), number("sender", F.col("from"), F.lit(1)), number("account", F.col("account_id"), F.lit(1)),
    )
    # A message counts once at each level above its tags.
    paths = F.array_distinct(F.flatten(F.transform(F.coalesce("tags", F.array()), lambda t: path_prefixes(t))))
    facets = F.transform(F.filter(paths, lambda p: p != ""), lambda p: F.struct(F.lit("facet").alias("part"), p.alias("key"), F.col("sign").cast("bigint").alias("n")))
    return rows.select(F.inline(F.concat(one, facets))).groupBy("part", "key").agg(F.sum("n").alias("n")).where("n <> 0")


def run(spark: SparkSession, source: str, root: str, files: int = 20, every: str | None = None) -> StreamingQuery:
    """Follows a folder of changes by id to its end, or at an interval; what each batch moves goes into root/moved."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(source)
    put = lambda batch, i: moved(batch).write.mode("overwrite").parquet(f"{root}/moved/batch={i}")
    writer = signed(changes).writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def numbers(spark: SparkSession, root: str) -> DataFrame:
    """(part, key, n) of all that is not zero; as many rows as there are days, senders, accounts and tags."""
    return spark.read.schema(NUMBERS).parquet(f"{root}/moved").groupBy("part", "key").agg(F.sum("n").alias("n")).where("n <> 0")


def dashboard(spark: SparkSession, root: str, now: int, days: int = ACTIVITY_DAYS, top: int = TOP) -> DataFrame:
    """The parts of aggregates.dashboard() that are sums, as (part, key, n): empty days too, the first senders and accounts."""
    held = numbers(spark, root)
    scalars = spark.createDataFrame([(p,) for p in ("count", "size", "with_attachment", "without_attachment")], "part string").join(held.where("key = ''"), "part", "left")
    rows = scalars.select("part", F.lit("").alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    calendar = spark.range((now - days * DAY_MS) // DAY_MS, now // DAY_MS + 1).select((F.col("id") * DAY_MS).cast("string").alias("key"))
    activity = calendar.join(held.where("part = 'activity'"), "key", "left").select(F.lit("activity"), "key", F.coalesce("n", F.lit(0)))
    rows = rows.union(activity)
    for part, by in (("sender", F.col("key")), ("account", F.col("key").cast("bigint"))):
        rows = rows.union(held.where(F.col("part") == part).orderBy(F.col("n").desc(), by).limit(top).select("part", "key", "n"))
    return rows
