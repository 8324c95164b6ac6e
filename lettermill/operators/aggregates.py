"""Counts, facets and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, path_prefixes

ACTIVITY_DAYS, TOP = 30, 10


def day(ms: Column) -> Column:
    return F.floor(ms / DAY_MS).cast("bigint") * DAY_MS


def daily_activity(envelopes: DataFrame, now: int, days: int = ACTIVITY_DAYS) -> DataFrame:
    """Messages of each UTC day from now - days to now, empty days too."""
    spark = envelopes.sparkSession
    counts = envelopes.where(F.col("date").between(now - days * DAY_MS, now)).groupBy(day(F.col("date")).alias("day")).agg(F.count("*").alias("n"))
    first = (now - days * DAY_MS) // DAY_MS
    calendar = spark.range(first, now // DAY_MS + 1).select((F.col("id") * DAY_MS).alias("day"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def top(envelopes: DataFrame, column: str, n: int = TOP) -> DataFrame:
    return envelopes.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column).asc()).limit(n)


def top_accounts(envelopes: DataFrame, accounts: DataFrame, n: int = TOP) -> DataFrame:
    """The accounts with most messages; the address is null where the account is unknown."""
    return top(envelopes, "account_id", n).join(accounts.select(F.col("id").alias("account_id"), "email"), "account_id", "left")


def largest(envelopes: DataFrame, n: int = TOP) -> DataFrame:
    return envelopes.orderBy(F.col("size").desc(), "id").limit(n).select("id", "subject", "size")


def scalars(envelopes: DataFrame) -> DataFrame:
    """One pass for everything that is a number."""
    with_one = F.count_if("has_attachment")
    return envelopes.agg(
        F.count("*").alias("email_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        with_one.alias("with_attachment"),
        (F.count("*") - with_one).alias("without_attachment"),
        F.coalesce(F.try_divide(with_one, F.count("*")), F.lit(0.0)).alias("attachment_ratio"),
    )


def max_uid(envelopes: DataFrame) -> DataFrame:
    return envelopes.groupBy("account_id", "mailbox_id").agg(F.max("uid").alias("max_uid"))


def facets(envelopes: DataFrame) -> DataFrame:
    """For each tag path and each ancestor, the messages with a tag there or below; a message counts once."""
    tag = envelopes.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    path = tag.select("id", F.explode(path_prefixes(F.col("tag"))).alias("path")).where("path <> ''")
    return path.distinct().groupBy("path").agg(F.count("*").alias("n"))


def dashboard(envelopes: DataFrame, accounts: DataFrame, now: int, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts over one narrow slice of the columns, which the caller may cache; for a scoped caller, of the rows and accounts in scope.

    stored (bytes) is the size of the store, none for a scoped caller.
    """
    part = envelopes.select("id", "account_id", "subject", "from", "date", "size", "has_attachment")
    none = accounts.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("bytes"))
    return {"scalars": scalars(part), "activity": daily_activity(part, now), "senders": top(part, "from"), "accounts": top_accounts(part, accounts), "largest": largest(part), "account_count": accounts.agg(F.count("*").alias("n")), "stored": none if stored is None else stored}


def dashboard_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts of a dashboard as one table (part, key, n)."""
    row = lambda name, n: F.struct(F.lit(name).alias("part"), F.lit("").alias("key"), F.col(n).cast("bigint").alias("n"))
    rows = parts["scalars"].select(F.inline(F.array(row("count", "email_count"), row("size", "total_size"), row("with_attachment", "with_attachment"), row("without_attachment", "without_attachment"))))
    rows = rows.union(parts["account_count"].select(F.lit("accounts"), F.lit(""), "n")).union(parts["stored"].select(F.lit("stored"), F.lit(""), "bytes"))
    for name, frame, key, n in (("activity", "activity", "day", "n"), ("sender", "senders", "from", "n"), ("account", "accounts", "account_id", "n"), ("largest", "largest", "id", "size")):
        rows = rows.union(parts[frame].select(F.lit(name), F.col(key).cast("string"), F.col(n)))
    return rows


def activity_rollup(envelopes: DataFrame) -> DataFrame:
    """Messages by account and sender, with totals of each account and of all."""
    return envelopes.rollup("account_id", "from").agg(F.count("*").alias("n"))
