"""The inverted index: full-text search without reading bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..operators.search import Search, condition

BUCKETS = 64
_FIELDS = {"subject": F.col, "text": F.col, "attachments": lambda c: F.array_join(c, "\n")}


def postings(envelopes: DataFrame, *kept: str) -> DataFrame:
    """(token, id, field, positions) and kept columns: places of a token among those of all fields, one field after the other.

    A row's postings come from the row alone, so nothing is shuffled: its tokens are sorted with their places, and each run of a token is one.
    """
    found = envelopes.select("id", *kept, *[tokens(text(name)).alias(f"_{name}") for name, text in _FIELDS.items()])
    before, parts = F.lit(0), []
    for name in _FIELDS:
        parts.append(F.struct(F.lit(name).alias("field"), before.alias("_before"), F.col(f"_{name}").alias("_tokens")))
        before = before + F.size(f"_{name}")
    rows = found.select("id", *kept, F.inline(F.array(*parts))).where(F.size("_tokens") > 0)
    placed = F.sort_array(F.transform("_tokens", lambda t, k: F.struct(t.alias("token"), (F.col("_before") + k).alias("at"))))
    rows = rows.select("id", *kept, "field", placed.alias("_placed"))
    token = lambda k: F.get("_placed", k)["token"]
    first = F.filter(F.sequence(F.lit(0), F.size("_placed") - 1), lambda k: (k == 0) | (token(k) != token(k - 1)))
    rows = rows.select("id", *kept, "field", "_placed", first.alias("_first"))
    places = lambda a, b: F.transform(F.slice("_placed", a + 1, b - a), lambda x: x["at"])
    runs = F.transform("_first", lambda a, j: F.struct(token(a).alias("token"), places(a, F.coalesce(F.get("_first", j + 1), F.size("_placed"))).alias("positions")))
    return rows.select("id", *kept, "field", F.inline(runs)).select("token", "id", "field", "positions", *kept)


def counts(envelopes: DataFrame) -> DataFrame:
    """(hash, n): how many postings each token has, without their places."""
    words = F.array(*[F.array_distinct(tokens(text(name))) for name, text in _FIELDS.items()])
    return envelopes.select(F.explode(F.flatten(words)).alias("token")).groupBy(F.xxhash64("token").alias("hash")).agg(F.count("*").alias("n"))


def _part(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write(envelopes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """An index in parts by a hash of the token (parts: how many), sorted by token, so that a look-up opens one part and few row groups."""
    rows = postings(envelopes).withColumns({"parts": F.lit(buckets), "part": _part(F.col("token"), buckets)})
    rows.repartition(buckets, "part", F.pmod("id", F.lit(8))).sortWithinPartitions("part", "token").write.option("compression", "zstd").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def looked_up(index: DataFrame, words: list[str]) -> DataFrame:
    """Rows of the words; of an index on disk only their parts are opened."""
    rows = index.where(F.col("token").isin(words))
    if "part" in index.columns and (first := index.select("parts").first()):
        buckets = first["parts"]
        rows = rows.where(F.col("part").isin([p for (p,) in index.sparkSession.createDataFrame([(w,) for w in words], "w string").select(_part(F.col("w"), buckets)).distinct().collect()]))
    return rows


def query_words(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(text))).first()[0]


def with_all(index: DataFrame, words: list[str]) -> DataFrame:
    """Ids of the messages that hold all the words."""
    wanted = sorted(set(words))
    return looked_up(index, wanted).select("id", "token").distinct().groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")


def with_any(index: DataFrame, words: list[str]) -> DataFrame:
    return looked_up(index, sorted(set(words))).select("id").distinct()


def with_phrase(index: DataFrame, words: list[str]) -> DataFrame:
    """Ids of the messages in which the words follow one another: for each place of a word, where the phrase would begin."""
    offsets = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for k, w in enumerate(words)])
    rows = looked_up(index, sorted(set(words))).select("id", "positions", F.explode(F.filter(offsets, lambda o: o["w"] == F.col("token"))).alias("o"))
    begins = rows.select("id", "o.k", F.explode("positions").alias("at")).select("id", "k", (F.col("at") - F.col("k")).alias("begin"))
    return begins.groupBy("id", "begin").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(words)).select("id").distinct()


def found(envelopes: DataFrame, index: DataFrame, words: list[str]) -> DataFrame:
    return envelopes.join(with_all(index, words), "id", "left_semi")


def search(envelopes: DataFrame, index: DataFrame, criteria: Search, accounts: list[int] | None = None) -> DataFrame:
    """What the scan of search() finds, with full-text criteria answered by the index; bodies are not read."""
    spark, c = envelopes.sparkSession, criteria
    rest = Search(**{**vars(c), "all_words": None, "any_words": None, "no_words": None, "phrase": None})
    rows = envelopes.where(condition(rest, accounts))
    wanted = [how(index, words) for how, text in ((with_all, c.all_words), (with_any, c.any_words), (with_phrase, c.phrase)) if text and (words := query_words(spark, text))]
    rows = reduce(lambda r, ids: r.join(ids, "id", "left_semi"), wanted, rows)
    return rows.join(with_any(index, words), "id", "left_anti") if c.no_words and (words := query_words(spark, c.no_words)) else rows
