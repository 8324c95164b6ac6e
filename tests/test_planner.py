"""The stateful plan of ingest against the batch plan, and what comes twice."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from lettermill.functions.columns import scoped_id
from lettermill.operators import folders, maintenance
from lettermill.streaming import ingest as stream
from lettermill.streaming import planner


def mail(spark, rows):
    """Landed messages (account_id, mailbox, uid, date, seq)."""
    frame = spark.createDataFrame(rows, "account_id bigint, mailbox string, uid bigint, internal_date bigint, seq bigint")
    body = F.format_string("Subject: s\r\nFrom: a@example.org\r\nMessage-ID: <%d-%s-%d-%d@x>\r\n\r\ntext %d", "account_id", "mailbox", "uid", "seq", "uid")
    return frame.select("account_id", "mailbox", "uid", "internal_date", F.lit(None).cast("bigint").alias("size"), F.encode(body, "UTF-8").alias("body"), "seq")


def listing(spark, rows):
    return spark.createDataFrame(rows, planner.REPORTS)


def as_batch(spark, before_rounds, messages, local, limit=None):
    """What folders.plan() and the high-water mark say for one round; local: {(account, folder): [validity, high, skipped]}."""
    remote = spark.createDataFrame(before_rounds, planner.REPORTS).withColumnRenamed("mailbox", "name")
    known = spark.createDataFrame([(*k, v[0]) for k, v in local.items()], "account_id bigint, name string, uid_validity bigint")
    actions = {(r["account_id"], r["name"]): r["action"] for r in folders.plan(remote, known).where("action <> 'keep'").collect()}
    fetched = set()
    for (account, name), action in actions.items():
        validity = next(r[2] for r in before_rounds if r[:2] == (account, name))
        held = local.setdefault((account, name), [validity, -1, False])
        held[2] = action == "skip"
        if action != "skip":
            held[0] = validity
        if action == "rebuild":
            held[1] = -1
    for key, held in local.items():
        new = {m[2] for m in messages if m[:2] == key and m[2] > held[1] and not held[2] and (limit is None or m[3] < limit)}
        held[1] = max({held[1], *new})
        fetched |= {(*key, uid) for uid in new}
    return set(actions.items()), fetched


def rounds(spark):
    yield [(1, "A", 7, 3, 10), (1, "B", 7, 0, 10), (2, "A", 5, 2, 10)], [(1, "A", u, u * 10, 10 + u) for u in (1, 2, 3)] + [(2, "A", u, u * 10, 10 + u) for u in (1, 2)] + [(9, "unlisted", 1, 10, 11)]
    # The known epoch with old uids again, an epoch that changed, one that the server doesn't tell, and a new folder.
    yield [(1, "A", 8, 2, 30), (1, "B", None, 0, 30), (2, "A", 5, 4, 30), (3, "N", 1, 1, 30)], [(1, "A", u, u, 30 + u) for u in (1, 2)] + [(1, "B", 1, 1, 31)] + [(2, "A", u, u, 30 + u) for u in (2, 3, 4)] + [(3, "N", 5, 5, 35)]
    yield [(1, "B", 7, 1, 50), (2, "A", None, 5, 50)], [(1, "B", 1, 1, 51), (2, "A", 9, 9, 59)]


@pytest.mark.parametrize("limit", [None, 25])
def test_stream_equals_the_batch_plan_after_each_trigger(spark, tmp_path, limit):
    source, listings, root = (f"{tmp_path}/{uuid.uuid4().hex}" for _ in range(3))
    local, seen = {}, set()
    for told, messages in rounds(spark):
        listing(spark, told).coalesce(1).write.mode("append").parquet(listings)
        mail(spark, messages).repartition(2).write.mode("append").parquet(source)
        planner.run(spark, source, listings, root, before=limit, cool_down_ms=0).awaitTermination()
        rows = [r for r in planner.decided(spark, root).collect() if (r["account_id"], r["mailbox"], r["action"], r["uid"], r["seq"]) not in seen]
        seen |= {(r["account_id"], r["mailbox"], r["action"], r["uid"], r["seq"]) for r in rows}
        actions, fetched = as_batch(spark, told, messages, local, limit)
        assert {((r["account_id"], r["mailbox"]), r["action"]) for r in rows if r["action"] != "fetch"} == actions
        assert {(r["account_id"], r["mailbox"], r["uid"]) for r in rows if r["action"] == "fetch"} == fetched
    # A rebuilt folder holds what was read anew only.
    now = maintenance.current(stream.written(spark, root, "envelopes")).join(spark.createDataFrame([(1, "A")], "a bigint, m string").select(scoped_id(F.col("a"), F.col("m")).alias("mailbox_id")), "mailbox_id")
    assert sorted(r["uid"] for r in now.select("uid").collect()) == [1, 2]
    n = planner.decided(spark, root).count()
    for told, messages in rounds(spark):  # all of it again: nothing is fetched twice
        mail(spark, messages).write.mode("append").parquet(source)
    planner.run(spark, source, listings, root, before=limit, cool_down_ms=0).awaitTermination()
    more = [tuple(r) for r in planner.decided(spark, root).collect()]
    assert len(more) == n


def test_a_folder_rests_after_a_load(spark, tmp_path):
    source, listings, root = (f"{tmp_path}/{uuid.uuid4().hex}" for _ in range(3))
    go = lambda: planner.run(spark, source, listings, root, cool_down_ms=15_000).awaitTermination()
    listing(spark, [(1, "A", 1, 1, 1)]).write.parquet(listings)
    mail(spark, [(1, "A", 1, 1, 2)]).write.parquet(source)
    go()
    began = time.time()
    mail(spark, [(1, "A", 2, 2, 3)]).write.mode("append").parquet(source)
    go()
    fetched = lambda: sorted(r["uid"] for r in planner.decided(spark, root).where("action = 'fetch'").collect())
    if time.time() - began < 13:
        assert fetched() == [1]
    time.sleep(max(0, 16 - (time.time() - began)))
    mail(spark, [(2, "elsewhere", 1, 1, 4)]).write.mode("append").parquet(source)
    go()
    assert fetched() == [1, 2]


def test_each_file_twice_is_written_once(spark, tmp_path):
    source, root = (f"{tmp_path}/{uuid.uuid4().hex}" for _ in range(2))
    rows = mail(spark, [(1, "A", u, u, u) for u in range(20)]).repartition(3)
    for _ in range(2):
        rows.write.mode("append").parquet(source)
    stream.run(spark, source, root, replays="7 days").awaitTermination()
    rows.write.mode("append").parquet(source)
    stream.run(spark, source, root, replays="7 days").awaitTermination()
    log = stream.written(spark, root, "envelopes")
    assert log.count() == log.select("id").distinct().count() == 20
