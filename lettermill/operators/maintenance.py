"""Writes as an append-only change log: upserts, tags, deletions of messages, folders and accounts; see snapshots for reading it fast.

An op row has op (upsert, delete, delete_mailbox, delete_account), seq, and the columns that it needs. seq is data, so the current
view does not depend on the order in which rows are read, and a batch that comes twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of keys that may go to every task.
MOST_SENT = 200_000
#: Bytes of a file of a snapshot, about.
FILE_BYTES = 256 << 20


def latest(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row of each key; Spark cuts each task's rows to one for a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(seq).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sent_if_few(rows: DataFrame) -> DataFrame:
    """Rows of a few bytes each: broadcast if they are few, else joined by a shuffle, in which Spark splits large keys."""
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def deduplicated(ids: DataFrame) -> DataFrame:
    return ids.dropDuplicates()


def current(log: DataFrame, tag_log: DataFrame | None = None) -> DataFrame:
    """Living rows of a log: the last upsert of each id, unless a later deletion hit the message, its folder or its account.

    tag_log (id, tags, seq) replaces the tags of the ids that it names; tags outlive a message that is read in again.
    """
    rows = latest(log.where("op = 'upsert'")).drop("op")
    ends = log.where("op <> 'upsert'")
    # Rows are dealt by id once, for the last version and for single deletions; those of folders and accounts go to them.
    one = ends.where("op = 'delete'").groupBy("id").agg(F.max("seq").alias("end_one"))
    box = sent_if_few(ends.where("op = 'delete_mailbox'").groupBy("account_id", "mailbox_id").agg(F.max("seq").alias("end_box")))
    account = sent_if_few(ends.where("op = 'delete_account'").groupBy("account_id").agg(F.max("seq").alias("end_account")))
    rows = rows.join(one, "id", "left").join(box, ["account_id", "mailbox_id"], "left").join(account, "account_id", "left")
    alive = rows.where("seq > coalesce(greatest(end_one, end_box, end_account), -1)").drop("end_one", "end_box", "end_account")
    return alive if tag_log is None else retagged(alive, tag_log)


def retagged(rows: DataFrame, tag_log: DataFrame) -> DataFrame:
    """Whole tag sets replaced by the last ones of the log; ids that are not there are skipped."""
    last = latest(tag_log).select("id", F.col("tags").alias("_tags"))
    return rows.join(last, "id", "left").withColumn("tags", F.coalesce("_tags", "tags")).drop("_tags")


def without_account(account_id: int, accounts: DataFrame, users: DataFrame, sync_state: DataFrame, mailboxes: DataFrame, envelopes: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    """All tables after an account goes, grants to it included."""
    other = F.col("account_id") != account_id
    grants = users.withColumn("account_access_map", F.map_filter("account_access_map", lambda k, _: k != account_id))
    return {"accounts": accounts.where(F.col("id") != account_id), "users": grants, "sync_state": sync_state.where(other), "mailboxes": mailboxes.where(other), "envelopes": envelopes.where(other), "raw": raw.where(other)}


def rebuilt(envelopes: DataFrame, account_id: int, mailbox_id: int, fresh: DataFrame) -> DataFrame:
    """A folder's rows replaced by fresh ones."""
    return envelopes.where((F.col("account_id") != account_id) | (F.col("mailbox_id") != mailbox_id)).unionByName(fresh)


def granted(users: DataFrame, user_ids: list[int], account_ids: list[int], role: int) -> DataFrame:
    """The role on all the accounts for all the users, in place of what they had there."""
    new = F.map_from_arrays(F.array(*[F.lit(a).cast("bigint") for a in account_ids]), F.array(*[F.lit(role).cast("bigint") for _ in account_ids]))
    rest = F.map_filter("account_access_map", lambda k, _: ~k.isin(account_ids))
    return users.withColumn("account_access_map", F.when(F.col("id").isin(user_ids), F.map_concat(rest, new)).otherwise(F.col("account_access_map")))


def append(rows: DataFrame, path: str) -> None:
    """Adds ops to a log, by day of the batch."""
    rows.write.mode("append").option("compression", "zstd").partitionBy("batch_date").parquet(path)


def restore_status(ids: DataFrame, envelopes: DataFrame, raw: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """For each asked id its folder, and ok or what is missing."""
    e = envelopes.select("id", "account_id", "mailbox_id", F.lit(True).alias("has_envelope"))
    r = raw.select("id", F.lit(True).alias("has_raw"))
    m = mailboxes.select("account_id", F.col("id").alias("mailbox_id"), F.col("name").alias("folder"))
    joined = ids.join(e, "id", "left").join(r, "id", "left").join(m, ["account_id", "mailbox_id"], "left")
    status = F.when(F.col("has_envelope").isNull(), "no_envelope").when(F.col("has_raw").isNull(), "no_raw").when(F.col("folder").isNull(), "no_folder").otherwise("ok")
    return joined.select("id", "folder", status.alias("status"))
