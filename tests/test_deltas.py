"""Numbers kept by retraction against those of all living rows, after every batch."""

import random
import uuid

from pyspark.sql import functions as F

from lettermill import fixtures as X
from lettermill.operators import aggregates, maintenance
from lettermill.streaming import deltas

DAY = 86_400_000


def changes(made, batch):
    for k in range(25):
        seq, id_ = 100 * batch + k if made.random() < 0.8 else made.randrange(100 * batch + 1), made.randrange(20)
        kind = made.choice(["upsert"] * 5 + ["delete", "tags"] + ["delete_mailbox"] * (k % 6 == 0) + ["delete_account"] * (k % 11 == 0))
        account, box = id_ % 3, id_ % 4
        yield {
            "upsert": (kind, seq, id_, account, box, f"u{made.randrange(4)}", X.NOW - made.randrange(20) * DAY - 5, made.randrange(100), made.random() < 0.4, made.sample(["/a", "/a/b", "/c/d"], made.randrange(3))),
            "delete": (kind, seq, id_, *[None] * 7),
            "tags": (kind, seq, id_, *[None] * 6, made.choice([[], ["/a/x", "/a/y"], ["/z"]])),
            "delete_mailbox": (kind, seq, None, account, box, *[None] * 5),
            "delete_account": (kind, seq, None, account, *[None] * 6),
        }[kind]


def test_numbers_follow_every_batch(spark, tmp_path):
    made, source, root, rows = random.Random(8), f"{tmp_path}/{uuid.uuid4().hex}", f"{tmp_path}/{uuid.uuid4().hex}", []
    accounts = spark.createDataFrame([(0, "x")], "id bigint, email string")
    living = spark.createDataFrame([], deltas.CHANGES)
    for batch in range(3):
        new = list({(r[1], r[0], r[2]): r for r in changes(made, batch)}.values())
        rows = list({(r[1], r[0], r[2]): r for r in rows + new}.values())
        frame = spark.createDataFrame(new, deltas.CHANGES)
        deltas.by_id(frame, living).select(frame.columns).coalesce(2).write.mode("append").parquet(source)
        deltas.run(spark, source, root).awaitTermination()
        log = spark.createDataFrame(rows, deltas.CHANGES)
        # A deletion that came late ends what came before it; here it is met by the rows of its time only.
        tag_log = log.where("op = 'tags'").select("id", "tags", "seq")
        held = maintenance.current(deltas.by_id(log.where("op <> 'tags'"), living), tag_log)
        parts = aggregates.dashboard(held.withColumn("subject", F.lit("")), accounts, X.NOW)
        want = {tuple(r) for r in aggregates.dashboard_rows(parts).where("part not in ('accounts', 'stored', 'largest')").collect()}
        assert {tuple(r) for r in deltas.dashboard(spark, root, X.NOW).collect()} == want
        facets = {(r["path"], r["n"]) for r in aggregates.facets(held).collect()}
        assert {(r["key"], r["n"]) for r in deltas.numbers(spark, root).where("part = 'facet'").collect()} == facets
        living = spark.createDataFrame(log.where("op = 'upsert'").select("id", "account_id", "mailbox_id").distinct().collect(), "id bigint, account_id bigint, mailbox_id bigint")
    before = sorted(map(tuple, deltas.numbers(spark, root).collect()))
    spark.read.schema(deltas.CHANGES).parquet(source).write.mode("append").parquet(source + "-again")
    spark.read.schema(deltas.CHANGES).parquet(source + "-again").write.mode("append").parquet(source)
    deltas.run(spark, source, root).awaitTermination()  # all of it again moves nothing
    assert sorted(map(tuple, deltas.numbers(spark, root).collect())) == before
