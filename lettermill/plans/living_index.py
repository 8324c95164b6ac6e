"""An inverted index that follows writes: a batch adds a segment, and what grew enough is merged, part by part.

A segment holds the postings of the rows of one batch, by parts of the token, each row with the seq of its message's version, and
the ids whose older versions ended. So a write reads its own rows only. A look-up opens the folders of the parts of its words, as
the manifest lists them, and leaves out postings of versions that ended. Tags are not indexed: changing them costs nothing.

Merging takes the parts whose young segments hold a share of what lies in the part already, and rewrites these parts alone without
ended versions; other parts keep their folders. A version of the manifest, one file, says which folders count, so readers see
a batch whole or not at all, and a batch that is written twice counts once.

A batch and a merge are worked off in rounds of ROUND_ROWS postings, about, so that what lies in shuffles and spills doesn't grow with
them: a batch by ranges of a hash of the id, a merge by groups of parts. Postings are shuffled once, to the file that they end in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import MOST_SENT, latest, sent_if_few
from ..operators.search import Search, condition
from .token_index import counts, postings, query_words

POSTINGS = "token string, id bigint, field string, positions array<int>, seq bigint"
_ENDED = "id bigint, seq bigint"
#: Spark's switch to remove a statement's shuffle files when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MANIFEST = "version bigint, parts int, batch bigint, part int, n_rows bigint, path string"
#: In place of a part: ids of which versions before a seq ended.
_ENDED_PART = -1
#: Postings of a part of a first segment, about, of a file, and of a round of writing.
PART_ROWS, FILE_ROWS, ROUND_ROWS = 20_000_000, 2_000_000, 25_000_000
#: Ids with the seq of their end that go to every task of a merge at once.
MOST_ENDED = 1_000_000
#: A part is merged when its young segments hold this share of the rows of its oldest one, or when so many have gathered.
MERGE_SHARE, MOST_SEGMENTS = 0.25, 16


def _freeing_disk(write: Callable) -> Callable:
    """A write whose statements remove their shuffle files as they end."""

    @wraps(write)
    def freeing(spark: SparkSession, *args, **kwargs):
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            return write(spark, *args, **kwargs)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)

    return freeing


def _part(token: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(parts)).cast("int")


def manifest(spark: SparkSession, root: str) -> list:
    """Folders (version, parts, batch, part, n_rows, path) of the newest version; empty before the first batch."""
    try:
        versions = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).collect()


def _publish(spark: SparkSession, root: str, version: int, rows: list[tuple]) -> None:
    spark.createDataFrame([(version, *r) for r in rows], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _write(rows: DataFrame, parts: int, found: dict[int, int], path: str) -> None:
    """Adds postings by part, sorted by token, to a folder. found: about how many a part has; those of a frequent token are dealt over files by id."""
    spark = rows.sparkSession
    files = F.broadcast(spark.createDataFrame([(p, max(1, -(-n // FILE_ROWS))) for p, n in found.items()], "part int, _files int"))
    dealt = rows.withColumn("part", _part(F.col("token"), parts)).join(files, "part").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files"))).drop("_files")
    ordered = dealt.repartition("part", "_file").sortWithinPartitions("part", "token").drop("_file")
    ordered.write.mode("append").option("compression", "zstd").partitionBy("part").parquet(path)


def _written(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(part, rows, folder) of each part in a folder."""
    written = spark.read.schema(POSTINGS + ", part int").parquet(path).groupBy("part").agg(F.count("*")).collect()
    return [(p, n, f"{path}/part={p}") for p, n in written]


def _slice(id: Column, slices: int) -> Column:
    """Of another hash than the one that deals rows over files."""
    return F.pmod(F.xxhash64(id, F.lit("slice")), F.lit(slices))


def _last_versions(upserts: DataFrame, path: str) -> DataFrame:
    """The last row of each id. Where few ids have several rows, and none its last one twice, texts are not shuffled for it. Ids with several are kept at path."""
    times = upserts.groupBy("id", "seq").agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("seq", "n")).alias("_last"), F.sum("n").alias("n"))
    times.where("n > 1").select("id", F.col("_last.seq").alias("_last"), "_last.n").write.option("compression", "zstd").parquet(path)
    several = upserts.sparkSession.read.schema("id bigint, _last bigint, n bigint").parquet(path)
    n, twice = several.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    if n > MOST_SENT or twice > 1:
        return latest(upserts)
    return upserts.join(F.broadcast(several.drop("n")), "id", "left").where("_last is null or seq = _last").drop("_last")


@_freeing_disk
def add(spark: SparkSession, root: str, batch: int, upserts: DataFrame, ended: DataFrame | None = None, part_rows: int = PART_ROWS) -> None:
    """Adds a batch: upserts (id, seq, subject, text, attachments), of which the last version of each id counts, and ended (id, seq): messages gone by a seq.

    A batch that is there already changes nothing. Batches come in the order of seq, as they do from a log.
    """
    known = manifest(spark, root)
    if any(r["batch"] >= batch for r in known):
        return
    folder = f"{root}/segment-{batch}-{uuid4().hex}"
    rows = _last_versions(upserts.select("id", "seq", "subject", "text", "attachments"), f"{folder}/several")
    # A version ends what stands before it, and a deletion that and the version of its own seq.
    gone = rows.select("id", "seq") if ended is None else rows.select("id", "seq").union(ended.select("id", F.col("seq") + 1))
    counts(rows).write.option("compression", "zstd").parquet(f"{folder}/counts")
    told = spark.read.schema("hash bigint, n bigint").parquet(f"{folder}/counts")
    total = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = known[0]["parts"] if known else max(1, -(-total // part_rows))
    rounds = -(-total // ROUND_ROWS)
    by_part = {r[0]: -(-r[1] // rounds) for r in told.groupBy(F.pmod("hash", F.lit(parts)).cast("int")).agg(F.sum("n")).collect()}
    for k in range(rounds):
        _write(postings(rows.where(_slice(F.col("id"), rounds) == k), "seq"), parts, by_part, f"{folder}/postings")
    found = _written(spark, f"{folder}/postings") if rounds else []
    rows = [tuple(r)[1:] for r in known] + [(parts, batch, p, n, path) for p, n, path in found]
    if known or ended is not None:
        gone.groupBy("id").agg(F.max("seq").alias("seq")).write.option("compression", "zstd").parquet(f"{folder}/ended")
        rows.append((parts, batch, _ENDED_PART, 0, f"{folder}/ended"))
    if rows:
        _publish(spark, root, known[0]["version"] + 1 if known else 0, rows)


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _living(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """Postings without those of versions that ended."""
    last = sent_if_few(ended.groupBy("id").agg(F.max("seq").alias("_ended")))
    return rows.join(last, "id", "left").where("_ended is null or seq >= _ended").drop("_ended")


@_freeing_disk
def merge(spark: SparkSession, root: str, share: float = MERGE_SHARE, most: int = MOST_SEGMENTS, everything: bool = False) -> list[int]:
    """Rewrites the parts that have grown by a share of themselves, or lie in too many segments, or all of them; returns them."""
    known = manifest(spark, root)
    by_part: dict[int, list] = {}
    for r in sorted(known, key=lambda r: r["batch"]):
        by_part.setdefault(r["part"], []).append(r)
    ended = by_part.pop(_ENDED_PART, [])
    grown = lambda rows: len(rows) > most or sum(r["n_rows"] for r in rows[1:]) >= share * rows[0]["n_rows"]
    due = [p for p, rows in by_part.items() if everything or len(rows) > 1 and grown(rows)]
    if not due:
        return []
    parts, folder = known[0]["parts"], f"{root}/merged-{uuid4().hex}"
    held = {p: sum(r["n_rows"] for r in by_part[p]) for p in due}
    gone = _read(spark, _ENDED, [r["path"] for r in ended])
    # So that ids that ended go to the tasks and postings stay where they are, too many of them are taken one share after the other.
    slices = max(1, -(-gone.count() // MOST_ENDED))
    for group in _groups(held):
        rows = _read(spark, POSTINGS, [r["path"] for p in group for r in by_part[p]])
        for k in range(slices):
            some = _slice(F.col("id"), slices) == k
            last = F.broadcast(gone.where(some).groupBy("id").agg(F.max("seq").alias("_ended")))
            living = rows.where(some).join(last, "id", "left").where("_ended is null or seq >= _ended").drop("_ended")
            _write(living, parts, {p: -(-held[p] // slices) for p in group}, f"{folder}/postings")
    found = _written(spark, f"{folder}/postings")
    # Once no part is as it was, all that ended has been left out.
    left = [] if len(due) == len(by_part) else [tuple(r)[1:] for r in known if r["part"] not in due]
    batch = max(r["batch"] for r in known)
    _publish(spark, root, known[0]["version"] + 1, left + ([(parts, batch, p, n, path) for p, n, path in found] or [(parts, batch, _ENDED_PART, 0, ended[-1]["path"])] * (not left)))
    return sorted(due)


def _groups(held: dict[int, int]) -> list[list[int]]:
    """Parts by rows, in groups of ROUND_ROWS together, or of one part that has more."""
    groups, n = [], 0
    for part, rows in sorted(held.items()):
        if not groups or n + rows > ROUND_ROWS:
            groups, n = [*groups, []], 0
        groups[-1].append(part)
        n += rows
    return groups


class LivingIndex:
    """The newest version for look-ups."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folders = spark, manifest(spark, root)

    def rows(self, words: list[str]) -> DataFrame:
        """Postings (token, id, field, positions) of the words in living versions; only the folders of their parts are opened."""
        wanted = sorted(set(words))
        parts = set()
        if self.folders:
            n = self.folders[0]["parts"]
            parts = {r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], "w string").select(_part(F.col("w"), n)).collect()}
        found = _read(self.spark, POSTINGS, [r["path"] for r in self.folders if r["part"] in parts])
        ended = _read(self.spark, _ENDED, [r["path"] for r in self.folders if r["part"] == _ENDED_PART])
        return _living(found.where(F.col("token").isin(wanted)), ended).drop("seq")

    def with_all(self, words: list[str]) -> DataFrame:
        """Ids of the messages that hold all the words: those of the rarest one, and of these the ones that hold the next."""
        rows = self.rows(words).select("token", "id").distinct()
        times = {r[0]: r[1] for r in rows.groupBy("token").agg(F.count("*")).collect()}
        ordered = sorted(set(words), key=lambda w: times.get(w, 0))
        holds = lambda w: rows.where(F.col("token") == w).select("id")
        return reduce(lambda ids, w: holds(w).join(sent_if_few(ids), "id", "left_semi"), ordered[1:], holds(ordered[0]))

    def with_any(self, words: list[str]) -> DataFrame:
        return self.rows(words).select("id").distinct()

    def with_phrase(self, words: list[str]) -> DataFrame:
        """Ids of the messages in which the words follow one another; only messages with all of them are looked at."""
        ids = sent_if_few(self.with_all(words))
        offsets = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for k, w in enumerate(words)])
        rows = self.rows(words).join(ids, "id", "left_semi").select("id", "positions", F.explode(F.filter(offsets, lambda o: o["w"] == F.col("token"))).alias("o"))
        begins = rows.select("id", "o.k", F.explode("positions").alias("at")).select("id", "k", (F.col("at") - F.col("k")).alias("begin"))
        return begins.groupBy("id", "begin").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(words)).select("id").distinct()

    def search(self, envelopes: DataFrame, criteria: Search, accounts: list[int] | None = None) -> DataFrame:
        """What the scan of search() finds; full-text criteria are answered by the index, and no body is read."""
        c = criteria
        rows = envelopes.where(condition(Search(**{**vars(c), "all_words": None, "any_words": None, "no_words": None, "phrase": None}), accounts))
        for how, text in ((self.with_all, c.all_words), (self.with_any, c.any_words), (self.with_phrase, c.phrase)):
            if text and (words := query_words(self.spark, text)):
                rows = rows.join(how(words), "id", "left_semi")
        if c.no_words and (words := query_words(self.spark, c.no_words)):
            rows = rows.join(self.with_any(words), "id", "left_anti")
        return rows
