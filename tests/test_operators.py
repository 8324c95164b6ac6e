import datetime

import pytest
from pyspark.sql import functions as F

from lettermill import fixtures as X
from lettermill.operators import access, aggregates, folders, ingest, maintenance
from lettermill.operators import search as S
from lettermill.plans import token_index


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_scope_none_and_empty_differ(spark, small):
    e = X.envelopes(spark, small)
    assert S.search(e, S.Search(), None).count() == e.count() > 0
    assert S.search(e, S.Search(), []).count() == 0


def test_page_limits(spark):
    for number, size in ((0, 10), (1, 0), (1, 501)):
        with pytest.raises(ValueError):
            S.page(spark.range(3).withColumn("date", F.col("id")), number, size)
    with pytest.raises(ValueError):
        S.Search(size_preset="huge")


def test_pages_make_up_the_whole(spark, small):
    e = X.envelopes(spark, small).select("id", "date").cache()
    whole = [r["id"] for r in S.page(e).collect()]
    parts = [r["id"] for k in range(1, 6) for r in S.page(e, k, 50).collect()]
    assert parts == whole[:250]
    seen, last = [], (None, None)
    for _ in range(3):
        rows = S.page_after(e, *last, 40).collect()
        seen += [r["id"] for r in rows]
        last = (rows[-1]["date"], rows[-1]["id"])
    assert seen == whole[:120]


def test_index_finds_what_the_scan_finds(spark, small, tmp_path):
    e = X.envelopes(spark, small)
    token_index.write(e, str(tmp_path / "index"), 4)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert ids(token_index.found(e, index, ["the", "and"])) == ids(S.search(e, S.Search(all_words="the and"))) != []
    first = e.where("size(split(text, ' ')) > 8").first()["text"].split()
    for c in (S.Search(all_words="the and", no_words="of"), S.Search(any_words="licensed und"), S.Search(phrase=" ".join(first[2:5])), S.Search(phrase="the and of it", has_attachment=True), S.Search(no_words="the")):
        assert ids(token_index.search(e, index, c)) == ids(S.search(e, c))
    plan = token_index.looked_up(index, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan


def test_filters_reach_the_scan(spark, small, tmp_path):
    X.envelopes(spark, small).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    plan = S.search(e, S.Search(since=5, account_id=3), [3]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "EqualTo(account_id" in plan and "text" not in plan.split("ReadSchema")[1]


def test_parent_facet_is_at_least_its_child(spark):
    rows = spark.createDataFrame([(1, ["/a/b", "/a/c"]), (2, ["/a/b"]), (3, [])], "id bigint, tags array<string>")
    assert {r["path"]: r["n"] for r in aggregates.facets(rows).collect()} == {"/a": 2, "/a/b": 2, "/a/c": 1}


def test_activity_fills_empty_days(spark, small):
    rows = aggregates.daily_activity(X.envelopes(spark, small).limit(0), X.NOW).collect()
    assert len(rows) == 31 and all(r["n"] == 0 for r in rows)


def test_uid_ranges(spark):
    uids = [40, 4, 21, 22, 5, 23, 41, 8, 42, 43]
    rows = spark.createDataFrame([(1, 1, u) for u in uids], "account_id bigint, mailbox_id bigint, uid bigint")
    got = {r["batch"]: r["uids"] for r in ingest.uid_ranges(ingest.uid_batches(rows, 4)).collect()}
    assert got == {0: "4:5,8,21", 1: "22:23,40:41", 2: "42:43"}


def test_errors_keep_the_last_thirty(spark):
    rows = spark.createDataFrame([(1, str(k), k) for k in range(45)], "account_id bigint, error string, at bigint")
    assert sorted(r["at"] for r in ingest.last_errors(rows).collect()) == list(range(15, 45))


def test_window_bounds(spark):
    day = F.lit(datetime.date(2024, 3, 31))
    got = [spark.range(1).select(ingest.window_bound(day, n, u)).first()[0] for n, u in ((1, "days"), (1, "months"), (1, "years"))]
    assert got == [datetime.date(2024, 3, 30), datetime.date(2024, 2, 29), datetime.date(2023, 3, 31)]
    with pytest.raises(ValueError):
        ingest.window_bound(day, 1, "weeks")
    now = datetime.date(2024, 3, 31)
    for wrong in ({}, {"fixed": "2024-03-31"}, {"fixed": "1969-12-31"}, {"fixed": "31.3.2024"}, {"fixed": "2024-01-01", "amount": 1, "unit": "days"}, {"amount": 55, "unit": "years"}, {"amount": 700, "unit": "months"}, {"amount": 19_900, "unit": "days"}, {"amount": 0, "unit": "days"}):
        with pytest.raises(ValueError):
            ingest.first_day(now, **wrong)
    for right in ({"fixed": "2024-03-30"}, {"fixed": "1970-01-01"}, {"amount": 54, "unit": "years"}, {"amount": 19_800, "unit": "days"}):
        ingest.first_day(now, **right)
    rows = spark.range(3).select(F.col("id").alias("date"))
    for since, before in (({"fixed": "2024-01-01"}, {"amount": 1, "unit": "days"}), (None, {"fixed": "2024-01-01"})):
        with pytest.raises(ValueError):
            ingest.in_window(rows, now, since, before)
    assert ingest.in_window(rows, now).count() == 3


def log(spark, rows):
    return spark.createDataFrame(rows, "op string, seq bigint, id bigint, account_id bigint, mailbox_id bigint, b string, tags array<string>")


@pytest.mark.parametrize("most", [0, 1000])
def test_change_log(spark, most, monkeypatch):
    rows = [
        ("upsert", 1, 1, 1, 1, "one", []), ("upsert", 2, 2, 1, 1, "two", []), ("upsert", 3, 3, 1, 2, "three", []), ("upsert", 4, 3, 1, 2, "THREE", []),
        ("delete", 5, 2, None, None, None, None), ("delete_mailbox", 6, None, 1, 2, None, None), ("upsert", 7, 4, 1, 2, "later", []), ("delete_account", 8, None, 2, None, None, None), ("upsert", 7, 5, 2, 9, "gone", []),
    ]
    want = {1: "one", 4: "later"}
    monkeypatch.setattr(maintenance, "MOST_SENT", most)
    for seen in (rows, rows[::-1], rows + rows[3:6]):
        assert {r["id"]: r["b"] for r in maintenance.current(log(spark, seen)).collect()} == want
    tags = spark.createDataFrame([(1, ["/x"], 9), (1, ["/y"], 8), (77, ["/z"], 9)], "id bigint, tags array<string>, seq bigint")
    assert {r["id"]: r["tags"] for r in maintenance.current(log(spark, rows), tags).collect()} == {1: ["/x"], 4: []}


def test_role_seed_is_valid(spark):
    roles = access.builtin_roles(spark)
    assert access.wrong_permissions(roles).count() == 0 and roles.count() == 5


def test_account_manager_may_read(spark):
    users = spark.createDataFrame([(1, [], {7: access.ROLE_IDS["account_manager"]}), (2, [access.ROLE_IDS["admin"]], {})], "id bigint, global_roles array<bigint>, account_access_map map<bigint,bigint>")
    asked = spark.createDataFrame([(1, 7, "data:read"), (1, 8, "data:read"), (2, 8, "data:delete"), (1, None, "user:view")], "user_id bigint, account_id bigint, permission string")
    got = {(r["user_id"], r["account_id"], r["permission"]): r["allowed"] for r in access.allowed(asked, users, access.builtin_roles(spark)).collect()}
    assert got == {(1, 7, "data:read"): True, (1, 8, "data:read"): False, (2, 8, "data:delete"): True, (1, None, "user:view"): False}


def test_tree_has_missing_ancestors(spark):
    paths = spark.createDataFrame([(1, "a/b/c", 2), (1, "a", 1)], "account_id bigint, name string, messages bigint")
    assert {(r["path"], r["parent"]) for r in folders.tree(paths).collect()} == {("a", None), ("a/b", "a"), ("a/b/c", "a/b")}
    assert {r["path"]: r["messages"] for r in folders.subtree_counts(paths).collect()} == {"a": 3, "a/b": 2, "a/b/c": 2}
