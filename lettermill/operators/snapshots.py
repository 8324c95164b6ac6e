"""Snapshots of a change log by month, and reading one together with the younger part of the log.

A snapshot is a list of folders, one for each month of date, with the living rows, and a folder of deletions, so that an op that comes
late still meets the one that it lost to. A reader merges the snapshot with the ops after it: rows of ids that these
touch are worked out anew, all others are read as they lie, without a shuffle. Making the next snapshot writes only months in
which a row came, went or changed; the others keep their folders. The manifest's newest version says which folders count.

Where dates are spread over more months than MOST_FOLDERS, a folder holds a range of months, about as many as any other one. Ranges don't
overlap; a month outside of all of them gets a folder of its own, until there are too many and all are laid out anew.

Ops are after a snapshot by their batch, where the log has one (a folder of files each, so older files are not opened), else by seq.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .maintenance import FILE_BYTES, current, latest, sent_if_few

#: A folder's months: from month to last, which is null where the folder holds one month.
_MANIFEST = "version bigint, upto bigint, tags_upto bigint, month string, path string, last string"
#: In place of a month: the folder of deletions.
_ENDS, _END_COLUMNS = "deletions", ("op", "id", "account_id", "mailbox_id")
_KEPT = ("tag_seq", "month")
#: Folders of a snapshot; half as many where months are laid out in ranges.
MOST_FOLDERS = 480
_DAY_MS, _MOST_DAYS = 86_400_000, 2_000_000_000


@dataclass
class Snapshot:
    """The newest version: how far it reaches in the log and in the log of tags, its folders by their first month, and the last months of those that hold a range."""

    version: int
    upto: int
    tags_upto: int
    paths: dict[str, str]
    lasts: dict[str, str]

    def ranges(self) -> list[tuple[str, int, int]]:
        """(first month, its place, the last one's) of each folder."""
        return [(m, _place_of(m), _place_of(self.lasts.get(m, m))) for m in self.paths if m != _ENDS]


def newest(spark: SparkSession, root: str) -> Snapshot | None:
    """None before the first snapshot."""
    try:
        versions = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    last = versions.agg(F.max("version")).first()[0]
    rows = versions.where(F.col("version") == last).collect()
    if not rows:
        return None
    return Snapshot(last, rows[0]["upto"], rows[0]["tags_upto"], {r["month"]: r["path"] for r in rows if r["month"]}, {r["month"]: r["last"] for r in rows if r["last"]})


def month(date: Column) -> Column:
    """The month of a time in milliseconds, in UTC; that of 0 for none."""
    days = F.least(F.greatest(F.floor(F.coalesce(date, F.lit(0)) / _DAY_MS), F.lit(-_MOST_DAYS)), F.lit(_MOST_DAYS))
    day = F.date_from_unix_date(days.cast("int"))
    return F.format_string("%04d-%02d", F.year(day), F.month(day))


def _place(months: Column) -> Column:
    """The number of a month in the order of time."""
    return F.substr(months, F.lit(1), F.length(months) - 3).cast("int") * 12 + F.substring(months, -2, 2).cast("int")


def _place_of(month: str) -> int:
    return int(month[:-3]) * 12 + int(month[-2:])


def _month_at(place: int) -> str:
    return f"{(place - 1) // 12:04d}-{(place - 1) % 12 + 1:02d}"


def _by(log: DataFrame) -> str:
    return "batch" if "batch" in log.columns else "seq"


def _after(log: DataFrame, upto: int) -> DataFrame:
    return log.where(F.col(_by(log)) > upto)


def _reach(log: DataFrame | None) -> int:
    return -1 if log is None else log.agg(F.coalesce(F.max(_by(log)), F.lit(-1)).cast("bigint")).first()[0]


def _row_schema(log: DataFrame) -> StructType:
    return StructType([f for f in log.schema if f.name not in ("op", "batch", *_KEPT)]).add("tag_seq", LongType()).add("month", StringType())


def rows_of(spark: SparkSession, log: DataFrame, found: Snapshot, months: list[str] | None = None) -> DataFrame:
    """Rows of a snapshot, of all its months or of the folders that begin with some."""
    return _lying(spark, log, found, months).drop("_folder")


def _lying(spark: SparkSession, log: DataFrame, found: Snapshot, months: list[str] | None) -> DataFrame:
    """Rows of a snapshot, each with the first month of its folder."""
    paths = [p for m, p in found.paths.items() if m != _ENDS and (months is None or m in months)]
    schema = _row_schema(log)
    if not paths:
        return spark.createDataFrame([], schema).withColumn("_folder", F.lit(""))
    return spark.read.schema(schema).parquet(*paths).select("*", F.regexp_extract("_metadata.file_path", "/_month=([^/]*)/[^/]*$", 1).alias("_folder"))


def _ends_of(log: DataFrame) -> DataFrame:
    return log.where("op <> 'upsert'").groupBy(*_END_COLUMNS).agg(F.max("seq").alias("seq"))


def _with_tags(rows: DataFrame, tag_log: DataFrame | None) -> DataFrame:
    """Tags replaced by the last ones of a log, if those are younger than the ones that rows already took from it."""
    if tag_log is None:
        return rows
    last = sent_if_few(latest(tag_log.select("id", "tags", "seq")).select("id", F.col("tags").alias("_tags"), F.col("seq").alias("_seq")))
    younger = F.col("_seq").isNotNull() & (F.col("tag_seq").isNull() | (F.col("_seq") > F.col("tag_seq")))
    rows = rows.join(last, "id", "left").withColumn("tags", F.when(younger, F.col("_tags")).otherwise(F.col("tags")))
    return rows.withColumn("tag_seq", F.when(younger, F.col("_seq")).otherwise(F.col("tag_seq"))).drop("_tags", "_seq")


@dataclass
class _Merge:
    """Rows that stay as they are, rows that are worked out anew, and those of the snapshot that are touched, by id or otherwise."""

    untouched: DataFrame
    fresh: DataFrame
    touched: DataFrame


def _merge(spark: SparkSession, log: DataFrame, tag_log: DataFrame | None, found: Snapshot, months: list[str] | None = None) -> _Merge:
    """Of the whole snapshot, or of some folders of it that hold all rows which are touched."""
    tail = _after(log, found.upto).drop("batch")
    tag_tail = None if tag_log is None else _after(tag_log, found.tags_upto)
    base = _lying(spark, log, found, months)
    columns = [c for c in base.columns if c != "_folder"]
    single = tail.where("op in ('upsert', 'delete')").select("id")
    ids = sent_if_few((single if tag_tail is None else single.union(tag_tail.select("id"))).distinct())
    # Deletions of whole folders and accounts since then; few, and each takes its rows out of the snapshot.
    box = sent_if_few(tail.where("op = 'delete_mailbox'").groupBy("account_id", "mailbox_id").agg(F.max("seq").alias("end_box")))
    account = sent_if_few(tail.where("op = 'delete_account'").groupBy("account_id").agg(F.max("seq").alias("end_account")))
    marked = base.join(ids.withColumn("_touched", F.lit(True)), "id", "left").join(box, ["account_id", "mailbox_id"], "left").join(account, "account_id", "left")
    ended = F.coalesce(F.greatest("end_box", "end_account") >= F.col("seq"), F.lit(False))
    marked = marked.withColumns({"_touched": F.coalesce("_touched", F.lit(False)), "_ended": ended}).drop("end_box", "end_account")
    ends = spark.read.schema(StructType([log.schema[c] for c in _END_COLUMNS] + [log.schema["seq"]])).parquet(found.paths[_ENDS])
    one = ends.where("op = 'delete'").join(ids, "id", "left_semi").unionByName(ends.where("op <> 'delete'"))
    again = marked.where("_touched").drop("_touched", "_ended", "_folder", "month").withColumn("op", F.lit("upsert"))
    own = again.select("id", F.col("tags").alias("_held"), F.col("tag_seq").alias("_held_seq"))
    told = again.drop("tag_seq").unionByName(tail).unionByName(one, allowMissingColumns=True)
    # A row that is read in again has the tags that it took from the log before.
    fresh = current(told).join(own, "id", "left").withColumn("tags", F.when(F.col("_held_seq").isNotNull(), F.col("_held")).otherwise(F.col("tags"))).withColumnRenamed("_held_seq", "tag_seq").drop("_held")
    if tag_log is not None:
        fresh = _with_tags(fresh, tag_log.join(ids, "id", "left_semi"))
    fresh = fresh.withColumn("month", month(F.col("date"))).select(*columns)
    return _Merge(marked.where("not _touched and not _ended").select(*columns), fresh, marked.where("_touched or _ended").select("_folder"))


def view(spark: SparkSession, root: str, log: DataFrame, tag_log: DataFrame | None = None) -> DataFrame:
    """Living rows: the newest snapshot below root and the ops after it, what maintenance.current() gives for the whole log."""
    found = newest(spark, root)
    if found is None:
        return current(log.drop("batch"), tag_log)
    merged = _merge(spark, log, tag_log, found)
    return merged.untouched.unionByName(merged.fresh).drop(*_KEPT)


def compact(log: DataFrame, tag_log: DataFrame | None, root: str) -> Snapshot:
    """Makes the next snapshot; only folders of months that changed since the newest one are written."""
    spark = log.sparkSession
    upto, tags_upto = _reach(log), _reach(tag_log)
    log = log.where(F.col(_by(log)) <= upto)
    tag_log = None if tag_log is None else tag_log.where(F.col(_by(tag_log)) <= tags_upto)
    found, folder = newest(spark, root), f"{root}/snapshot-{uuid4().hex}"
    if found is None:
        rows = _with_tags(current(log.drop("batch")).withColumn("tag_seq", F.lit(None).cast("bigint")), tag_log)
        rows, ranges, ends, left = rows.withColumn("month", month(F.col("date"))), [], _ends_of(log), {}
    else:
        merged, ranges = _merge(spark, log, tag_log, found), found.ranges()
        fresh = _placed(merged.fresh.select("month").distinct(), ranges).select(F.coalesce("_folder", F.lit("")).alias("_folder"))
        met = fresh.withColumn("_new", F.lit(1)).union(merged.touched.withColumn("_new", F.lit(0)).distinct()).groupBy("_folder").agg(F.sum("_new").alias("n")).collect()
        changed = [r["_folder"] for r in met if r["_folder"]]
        # Months in no folder yet get one each, while there is room.
        if len(ranges) + sum(r["n"] for r in met if not r["_folder"]) > MOST_FOLDERS:
            changed, ranges = [m for m, _, _ in ranges], []
        merged = _merge(spark, log, tag_log, found, changed)
        rows = merged.untouched.unionByName(merged.fresh)
        old = spark.read.schema(StructType([log.schema[c] for c in _END_COLUMNS] + [log.schema["seq"]])).parquet(found.paths[_ENDS])
        ends = old.withColumn("op", F.col("op")).unionByName(_ends_of(_after(log, found.upto)))
        ends = ends.groupBy(*_END_COLUMNS).agg(F.max("seq").alias("seq"))
        left = {m: p for m, p in found.paths.items() if m != _ENDS and m not in changed}
    lasts = _write_months(rows, folder, ranges)
    ends.coalesce(1).write.option("compression", "zstd").parquet(f"{folder}/{_ENDS}")
    # A month's column stays in its files, so that each folder can be read by itself.
    written = [r[0] for r in spark.read.schema("_month string").parquet(f"{folder}/rows").select("_month").distinct().collect()]
    paths = left | {m: f"{folder}/rows/_month={m}" for m in written} | {_ENDS: f"{folder}/{_ENDS}"}
    lasts = {m: last for m, last in lasts.items() if m in paths and m != last}
    version = 0 if found is None else found.version + 1
    spark.createDataFrame([(version, upto, tags_upto, m, p, lasts.get(m)) for m, p in paths.items()], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return Snapshot(version, upto, tags_upto, paths, lasts)


def _placed(months: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Months with the first month of the folder in whose range they are, null for none."""
    if not ranges:
        return months.withColumn("_folder", F.lit(None).cast("string"))
    known = F.broadcast(months.sparkSession.createDataFrame(ranges, "_folder string, _from int, _to int"))
    return months.join(known, _place(F.col("month")).between(F.col("_from"), F.col("_to")), "left").drop("_from", "_to")


def _laid_out(months: DataFrame) -> list[tuple[str, int, int]]:
    """Ranges with about as many months each, none where every month can have a folder of its own."""
    n = MOST_FOLDERS // 2
    place = _place(F.col("month"))
    found = months.agg(F.count("*").alias("n"), F.min(place).alias("least"), F.max(place).alias("most"), F.percentile_approx(place, [k / n for k in range(1, n)], 20 * n).alias("cuts")).first()
    if found["n"] <= MOST_FOLDERS:
        return []
    firsts = sorted({found["least"], *found["cuts"]})
    return [(_month_at(a), a, b - 1) for a, b in zip(firsts, [*firsts[1:], found["most"] + 1])]


def _write_months(rows: DataFrame, folder: str, ranges: list[tuple[str, int, int]]) -> dict[str, str]:
    """As many files for each folder as its bytes ask for, in the order of date; new ranges where there are none. Returns the last months of ranges."""
    spark = rows.sparkSession
    size = F.sum("size") if "size" in rows.columns else F.count("*") * 1024
    rows.groupBy("month").agg(size.cast("bigint").alias("bytes")).write.option("compression", "zstd").parquet(f"{folder}/months")
    months = spark.read.schema("month string, bytes bigint").parquet(f"{folder}/months")
    ranges = ranges or _laid_out(months)
    months = _placed(months, ranges).select("month", "bytes", F.coalesce("_folder", "month").alias("_month"))
    files = months.groupBy("_month").agg(F.greatest(F.ceil(F.sum("bytes") / FILE_BYTES), F.lit(1)).cast("int").alias("_files"))
    rows = rows.join(sent_if_few(months.join(files, "_month").drop("bytes")), "month").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files"))).drop("_files")
    ordered = rows.repartition("_month", "_file").sortWithinPartitions("_month", "date").drop("_file")
    ordered.write.option("compression", "zstd").partitionBy("_month").parquet(f"{folder}/rows")
    return {m: _month_at(last) for m, _, last in ranges}
