"""Planning of incremental ingest from tables of state; the present is always an argument."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS

COOL_DOWN_MS, LEAST_LOAD, ERRORS_KEPT, BATCH = 60_000, 100, 30, 50


def run_action(accounts: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """initial without state; incremental when the interval has passed; else skip. An initial run that just ended or failed rests first."""
    rows = accounts.where("enabled").join(state.withColumn("has_state", F.lit(True)), accounts["id"] == state["account_id"], "left")
    resting = F.coalesce(F.greatest("initial_end", "initial_failed") > now - COOL_DOWN_MS, F.lit(False))
    due = F.lit(now) - F.col("last_start") > F.col("sync_interval_min") * 60_000
    return rows.select("id", F.when(F.col("has_state").isNull(), "initial").when(resting, "skip").when(due, "incremental").otherwise("skip").alias("action"))


def window_bound(now: Column, amount: int, unit: str) -> Column:
    """now (a date) less an amount of days, months or years."""
    if unit not in ("days", "months", "years") or amount < 1:
        raise ValueError("an amount of at least 1 and days, months or years are needed")
    return F.date_sub(now, amount) if unit == "days" else F.add_months(now, -amount * (12 if unit == "years" else 1))


def first_day(now: datetime.date, fixed: str | None = None, amount: int | None = None, unit: str | None = None) -> Column:
    """The first day of a window: either a fixed one, as YYYY-MM-DD, before today, or so many days, months or years ago; never before 1970."""
    if (fixed is None) == (amount is None):
        raise ValueError("either a fixed day or an amount is needed, not both")
    if fixed is not None:
        day = datetime.datetime.strptime(fixed, "%Y-%m-%d").date()
        if day >= now:
            raise ValueError(f"{fixed} is not in the past")
        bound, year = F.lit(day), day.year
    else:
        bound = window_bound(F.lit(now), amount, unit)
        year = {"days": (now.toordinal() - amount - 1) // 365.2425 + 1, "months": (now.year * 12 + now.month - 1 - amount) // 12, "years": now.year - amount}[unit]
    if year < 1970:
        raise ValueError("a window begins in 1970 at the earliest")
    return bound


def in_window(rows: DataFrame, now: datetime.date, since: dict | None = None, before: dict | None = None, column: str = "date") -> DataFrame:
    """Messages since a day, or of before a day; since as first_day() takes it, before as an amount and unit only, and not both."""
    if since and before:
        raise ValueError("since and before exclude each other")
    if before and before.get("fixed") is not None:
        raise ValueError("before takes an amount only")
    if not (since or before):
        return rows
    bound = F.unix_date(first_day(now, **(since or before))).cast("bigint") * DAY_MS
    return rows.where(F.col(column) >= bound) if since else rows.where(F.col(column) < bound)


def after_high_water(candidates: DataFrame, high: DataFrame, before: int | None = None) -> DataFrame:
    """Messages with a uid above what the folder holds (all of a folder that holds none), and older than before where that is set."""
    rows = candidates.join(high, ["account_id", "mailbox_id"], "left").where(F.col("uid") > F.coalesce("max_uid", F.lit(-1)))
    return rows if before is None else rows.where(F.col("date") < before)


def load_size(total: Column, limit: int | None) -> Column:
    """Messages of a full load: all, or the limit raised to a hundred where there are more."""
    return total if limit is None else F.when(F.lit(limit) < total, F.least(total, F.greatest(F.lit(limit), F.lit(LEAST_LOAD)))).otherwise(total)


def first_n(rows: DataFrame, limit: int, newest: bool) -> DataFrame:
    """The newest or oldest uids of each folder, at least a hundred."""
    n = max(limit, LEAST_LOAD)
    w = Window.partitionBy("account_id", "mailbox_id").orderBy(F.col("uid").desc() if newest else F.col("uid").asc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def uid_batches(rows: DataFrame, size: int = BATCH, descending: bool = False) -> DataFrame:
    """A batch number for each uid of a folder, in the order of reading."""
    w = Window.partitionBy("account_id", "mailbox_id").orderBy(F.col("uid").desc() if descending else F.col("uid").asc())
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def uid_ranges(batches: DataFrame) -> DataFrame:
    """Each batch's uids as ranges, such as 1:3,5."""
    keys = ["account_id", "mailbox_id", "batch"]
    w = Window.partitionBy(*keys).orderBy("uid")
    islands = batches.select(*keys, "uid").distinct().withColumn("island", F.col("uid") - F.row_number().over(w))
    ranges = islands.groupBy(*keys, "island").agg(F.min("uid").alias("low"), F.max("uid").alias("high"))
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws(":", "low", "high"))
    return ranges.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", text.alias("text")))), lambda r: r["text"]), ",").alias("uids"))


def sequence_windows(folders: DataFrame, size: int, from_end: bool) -> DataFrame:
    """Pages of message numbers 1 to exists of each folder, clamped; folders: account_id, name, exists."""
    pages = folders.where(F.col("exists") > 0).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("exists") / size).cast("bigint"))).alias("page"))
    low = F.greatest(F.col("exists") - F.col("page") * size + 1, F.lit(1)) if from_end else (F.col("page") - 1) * size + 1
    high = F.col("exists") - (F.col("page") - 1) * size if from_end else F.least(F.col("page") * size, "exists")
    return pages.select("account_id", "name", "page", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def progress(events: DataFrame) -> DataFrame:
    """Last total and furthest batch of each folder from events (account_id, folder, total, current, at)."""
    rows = events.groupBy("account_id", "folder").agg(F.max_by("total", F.struct("at", "total")).alias("total"), F.max("current").alias("current"))
    return rows.withColumn("complete", F.col("current") == F.col("total"))


def last_errors(errors: DataFrame, kept: int = ERRORS_KEPT) -> DataFrame:
    """The last errors of each account (account_id, error, at)."""
    w = Window.partitionBy("account_id").orderBy(F.col("at").desc(), F.col("error").desc())
    return errors.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= kept).drop("_n")
