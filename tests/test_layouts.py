"""Layouts give the rows of plain reads, and plans that move or open less."""

import uuid

import pytest
from pyspark.sql import functions as F

from lettermill import fixtures as X
from lettermill.operators import access
from lettermill.operators import search as S
from lettermill.plans import layouts


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def mail(spark, small):
    return X.envelopes(spark, small).select("id", "account_id", "uid", "date", "text").cache()


def test_join_by_bucket_moves_nothing(spark, mail, tmp_path):
    raw = mail.select("id", "account_id", F.encode("text", "UTF-8").alias("eml"))
    n = layouts.buckets_for(raw, 100_000)
    assert n > 2 and layouts.buckets_for(raw.limit(0)) == 1
    e, r = (layouts.write_bucketed(f, f"{tmp_path}/{uuid.uuid4().hex}", n) for f in (mail.drop("text"), raw))
    joined = layouts.with_raw(e, r)
    assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    assert rows_of(joined.select("id", F.length("eml"))) == rows_of(mail.select("id", F.octet_length("text")))


def test_scope_opens_folders_of_its_accounts(spark, small, mail, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    layouts.write_by_account(mail, path, 20)
    table = layouts.read_by_account(spark, path, mail.schema)
    scope = access.read_scope(X.users(spark, small), access.builtin_roles(spark))
    narrow = access.scoped(table, scope, 7)
    assert "dynamicpruning" in plan_of(narrow).lower() and rows_of(narrow.select("id")) == rows_of(access.scoped(mail, scope, 7).select("id"))
    opened = {r[0] for r in narrow.select(F.col("account_id")).distinct().collect()}
    assert opened <= {7, 14} and 0 < narrow.count() < mail.count()
    wide = access.scoped(table, scope, 10)
    assert "Join" not in plan_of(wide) and wide.count() == mail.count()
    assert access.scoped(table, scope, -1).count() == 0


def test_page_at_any_depth(spark, mail, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    layouts.write_ranges(mail, path, 30)
    total = mail.count()
    assert spark.read.parquet(f"{path}/ranges").count() > 3
    for number, size in ((1, 10), (4, 17), (total // 7 + 1, 7), (3, 50), (2, total), (total, 5)):
        page = layouts.page_of_ranges(spark, path, mail.schema, number, size)
        assert [r["id"] for r in page.collect()] == [r["id"] for r in S.page(mail, number, size, limit_size=False).collect()]
    one = layouts.page_of_ranges(spark, path, mail.schema, total, 1)
    assert "PartitionFilters" in plan_of(one) and len({r[0] for r in spark.read.parquet(f"{path}/rows").where(F.col("range").isin([0])).select("range").distinct().collect()}) == 1
    empty = f"{tmp_path}/{uuid.uuid4().hex}"
    layouts.write_ranges(mail.limit(0), empty)
    assert layouts.page_of_ranges(spark, empty, mail.schema, 1, 5).count() == 0
    with pytest.raises(ValueError):
        layouts.page_of_ranges(spark, path, mail.schema, 0, 5)
