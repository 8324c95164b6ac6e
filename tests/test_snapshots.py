"""A snapshot with the ops after it against the whole log, after every batch."""

import random

import pytest
from pyspark.sql import functions as F

from lettermill.operators import maintenance, snapshots

OPS = "op string, seq bigint, id bigint, account_id bigint, mailbox_id bigint, date bigint, size bigint, body string, tags array<string>, batch bigint"
DAY = 86_400_000


def ops(made, batch, n, late):
    """Random ops; where late, some are older than those of earlier batches."""
    for k in range(n):
        seq = 100 * batch + k if not late or made.random() < 0.7 else made.randrange(100 * batch + 1)
        id_ = made.randrange(25)
        account, box = id_ % 3, id_ % 5
        kind = made.choice(["upsert"] * 7 + ["delete"] * 2 + ["delete_mailbox"] * (k % 4 == 0) + ["delete_account"] * (k % 9 == 0))
        yield {
            "upsert": ("upsert", seq, id_, account, box, made.choice([0, 40, 80]) * DAY, 10 + k, f"{id_} at {seq}", [f"/own/{seq}"], batch),
            "delete": ("delete", seq, id_, None, None, None, None, None, None, batch),
            "delete_mailbox": ("delete_mailbox", seq, None, account, box, None, None, None, None, batch),
            "delete_account": ("delete_account", seq, None, account, None, None, None, None, None, batch),
        }[kind]


def held(frame):
    return sorted((r["id"], r["seq"], r["date"], r["body"], tuple(r["tags"])) for r in frame.collect())


@pytest.mark.parametrize("late", [False, True])
def test_view_equals_the_whole_log(spark, tmp_path, late):
    made, rows, tag_rows, root = random.Random(3), [], [], str(tmp_path / "snapshots")
    for batch in range(4):
        rows += [(*r[:1], *r[1:]) for r in ops(made, batch, 12, late)]
        tag_rows += [(made.randrange(25), [f"/tag/{batch}/{k}"], 100 * batch + 50 + k, batch) for k in range(3)]
        log = spark.createDataFrame({(r[1], r[0], r[2]): r for r in rows}.values(), OPS)
        tag_log = spark.createDataFrame(tag_rows, "id bigint, tags array<string>, seq bigint, batch bigint")
        want = held(maintenance.current(log.drop("batch"), tag_log))
        if batch > 1:
            assert held(snapshots.view(spark, root, log, tag_log)) == want
        if batch in (1, 2):
            snapshots.compact(log, tag_log, root)
            found = snapshots.newest(spark, root)
            assert held(snapshots.rows_of(spark, log, found)) == want and found.upto == batch


def test_months_without_changes_stay_in_place(spark, tmp_path):
    root, path = str(tmp_path / "s"), str(tmp_path / "log")
    put = lambda rows, batch: spark.createDataFrame(rows, OPS).drop("batch").write.mode("append").parquet(f"{path}/batch={batch}")
    log = lambda: spark.read.schema(OPS).parquet(path)
    put([("upsert", k, k, 1, k % 2, (k % 3) * 40 * DAY, 5, "x", [], 0) for k in range(30)], 0)
    first = snapshots.compact(log(), None, root)
    months = sorted(m for m in first.paths if m != "deletions")
    assert len(months) == 3
    put([("delete", 100, 3, None, None, None, None, None, None, 1), ("upsert", 101, 50, 1, 1, 0, 5, "new", [], 1)], 1)
    # What is read of the log are the files of the younger batch.
    tail = snapshots._after(log(), first.upto)
    assert all("batch=1" in f for f in tail.inputFiles() if tail.count()) or "PartitionFilters: [isnotnull(batch" in tail._jdf.queryExecution().executedPlan().toString()
    plan = snapshots.view(spark, root, log())._jdf.queryExecution().executedPlan().toString()
    assert "batch" in plan and "BroadcastHashJoin" in plan
    second = snapshots.compact(log(), None, root)
    assert second.paths[months[0]] != first.paths[months[0]]
    assert [second.paths[m] for m in months[1:]] == [first.paths[m] for m in months[1:]]
    put([("delete", 200 + k, k, None, None, None, None, None, None, 2) for k in range(2, 30, 3)], 2)
    third = snapshots.compact(log(), None, root)
    assert months[2] not in third.paths and third.paths[months[1]] == first.paths[months[1]]
    assert held(snapshots.view(spark, root, log())) == held(maintenance.current(log().drop("batch")))


def test_no_snapshot_and_no_rows(spark, tmp_path):
    log = spark.createDataFrame([("upsert", 1, 1, 1, 1, 0, 5, "x", [], 0)], OPS)
    assert held(snapshots.view(spark, str(tmp_path / "none"), log)) == [(1, 1, 0, "x", ())]
    root = str(tmp_path / "empty")
    snapshots.compact(log.limit(0), None, root)
    assert held(snapshots.view(spark, root, log.limit(0))) == [] and held(snapshots.view(spark, root, log)) == [(1, 1, 0, "x", ())]
    snapshots.compact(log, None, root)
    assert held(snapshots.view(spark, root, log.withColumn("batch", F.lit(0).cast("bigint")))) == [(1, 1, 0, "x", ())]


def test_streamed_logs_are_compacted(spark, tmp_path):
    from lettermill.streaming import ingest

    land, root, kept = str(tmp_path / "land"), str(tmp_path / "logs"), str(tmp_path / "kept")
    for batch in range(3):
        rows = [(1, "INBOX", 10 * batch + k, 1000, None, bytearray(b"Subject: s\r\nMessage-ID: <%d@x>\r\nDate: Wed, 03 Jan 2024 10:00:00 +0000\r\n\r\nin %d" % (k + batch, batch)), 10 * batch + k) for k in range(6)]
        spark.createDataFrame(rows, ingest.LANDING).coalesce(1).write.mode("append").parquet(land)
        ingest.run(spark, land, root).awaitTermination()
        log = ingest.written(spark, root, "envelopes")
        want = sorted((r["id"], r["uid"], r["text"]) for r in maintenance.current(log.drop("batch")).collect())
        if batch:
            found = snapshots.view(spark, kept, log)
            assert sorted((r["id"], r["uid"], r["text"]) for r in found.collect()) == want
        if batch < 2:
            assert snapshots.compact(log, None, kept).upto == batch
    assert len(want) == 8


def test_many_months_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 8, raising=False)
    root, far = str(tmp_path / "s"), 10**15
    up = lambda k, date, batch, body="x": ("upsert", 100 * batch + k, k, 1, k % 2, date, 5, body, [], batch)
    folders = lambda s: {m: p for m, p in s.paths.items() if m != "deletions"}
    # One date is missing; then come a change, dates before year 0 and after year 9999, and more months in between than there is room for.
    rows = [up(k, date, 0) for k, date in enumerate([None, 0] + [k * 40 * DAY for k in range(30)])]
    batches = [[], [up(20, 19 * 40 * DAY, 1, "new"), ("delete", 150, 4, None, None, None, None, None, None, 1)], [up(40, -3 * far, 2), up(41, 3 * far, 2)], [up(50 + k, (100 + 5 * k) * 40 * DAY, 3) for k in range(12)]]
    seen = []
    for batch, more in enumerate(batches):
        rows += more
        log = spark.createDataFrame(rows, OPS)
        want = held_or_none(maintenance.current(log.drop("batch")))
        if batch:
            assert held_or_none(snapshots.view(spark, root, log)) == want
        seen.append(folders(snapshots.compact(log, None, root)))
        found = snapshots.newest(spark, root)
        assert held_or_none(snapshots.rows_of(spark, log, found)) == want and folders(found) == seen[-1] and len(seen[-1]) <= 8
    # A change leaves other folders where they were, new months add theirs, and too many of them have all laid out anew.
    stay = [len(set(a.values()) & set(b.values())) for a, b in zip(seen, seen[1:])]
    assert [len(s) for s in seen[:3]] == [4, 4, 6] and stay == [2, 4, 0]


def held_or_none(frame):
    return sorted(((r["id"], r["seq"], r["date"], r["body"]) for r in frame.collect()), key=str)
