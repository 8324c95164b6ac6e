"""Line dedup by the number of distinct sites that a line stands on.

HyperLogLog sketches of the sites of each line merge by aggregation, so a line that stands in a third of all documents
costs each task one small sketch. Where an estimate lies too near the threshold to tell, exact distinct counts decide.
Lines on at least MIN_SITES sites are boilerplate and leave every document. A passage, a line of LONG_WORDS words or more, that
stands in several texts on fewer sites stays in the first of them, by id, and leaves the others.

Copies are one text: what all of them hold stands once, on the site of the least id among them that has one, so that a
text with many copies makes no boilerplate and stays whole in each. Copies are rows of equal text; over near-duplicate
classes (as in the pipeline) they are all rows of a class.

Lines are what stands between line feeds, compared without blanks at either end; blank lines are never removed. Results for
odd rows: a null text stays null and an empty one empty, with no lines removed; a
null site is no site; rows with equal or null ids are each cleaned alike; all other columns stay as they are; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import jaccard_classes, row_key
from .work import SMALL_ROWS, kept, quoted, row_of, small, table

MIN_SITES, LONG_WORDS = 5, 50
LG_K, SIGMAS = 12, 4
#: Parts into which the rows of a line are dealt where its key can't go to every task.
SALT = 16
_WORD = r"[^ \t\r\n]+"


def _key(line: Column) -> Column:
    """64 bits of one hash, and the length: what lines are compared by."""
    return F.struct(F.xxhash64(F.trim(line)).alias("hash"), F.length(F.trim(line)).alias("size"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _with_line(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows joined to a kept table of line keys, without a task that gets all rows of one line."""
    if keys.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(keys), "line", how)
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")).join(salted, ["line", "salt"], how).drop("salt")


def _told_apart(docs: DataFrame, id_column: str, site_column: str, text_column: str, over_classes: bool) -> DataFrame:
    """key, text, row (all columns), site and own (none, id, key: the text that a row is a copy of) for each row of docs."""
    id_, text = F.col(quoted(id_column)), F.col(quoted(text_column))
    key = row_key(id_column, text_column) if over_classes else F.unhex(F.md5(text))
    rows = docs.select(id_.alias("id"), F.col(quoted(site_column)).cast("string").alias("site"), text.alias("text"), key.alias("key"), row_of(docs))
    if over_classes:
        found = jaccard_classes(docs, id_column, text_column).where("n_copies > 1 or n_links > 0").select(F.col("row").alias("key"), "head").distinct()
        copies = kept(rows.select("id", "site", "key").join(small(kept(found, "copies")), "key"), "copies-of")
        by = "head"
    else:
        copies, by = rows.where("key is not null").select("id", "site", "key"), "key"
    named = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    texts = copies.groupBy(by).agg(F.count("*").alias("n"), F.min(named).alias("own"), F.min(F.when(F.col("site").isNotNull(), F.struct(named.alias("at"), "site")))["site"].alias("site")).where("n > 1")
    if over_classes:
        texts = copies.select("key", "head").distinct().join(texts, "head")
    texts = small(kept(texts.select("key", F.col("own").alias("of"), F.col("site").alias("of_site")), "copied"))
    own = F.coalesce("of", named).alias("own")
    return rows.join(texts, "key", "left").select("key", "id", "text", "row", F.when(F.col("of").isNotNull(), F.col("of_site")).otherwise(F.col("site")).alias("site"), own)


def repeated_lines(rows: DataFrame, min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, lg_k: int = LG_K) -> DataFrame:
    """(line, first) of the lines to remove; first is the text in which one stays, null for boilerplate. rows: text, site, own."""
    lines = rows.select("site", "own", F.explode(F.filter(_lines(F.col("text")), lambda x: x.rlike(_WORD))).alias("line"))
    long = F.when(F.length("line") >= 2 * long_words - 1, F.regexp_count("line", F.lit(_WORD)) >= long_words).otherwise(False)
    lines = lines.select("site", "own", long.alias("long"), _key(F.col("line")).alias("line"))
    error = 1 + min_sites * SIGMAS * 1.04 / 2 ** (lg_k / 2)
    found = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min("own").alias("first"), F.max("own").alias("last"), F.max("long").alias("long"))
    found = kept(found.where((F.coalesce("sites", F.lit(0)) >= min_sites - error) | F.col("long") & (F.col("first") < F.col("last"))), "repeated-lines")
    near = kept(found.where(F.col("sites").between(min_sites - error, min_sites + error)).select("line"), "near-lines")
    # Sites of a line come down to distinct ones where they are read, so a line that stands everywhere sends few rows.
    some = lines.where("site is not null").select("line", "site")
    some = some.join(F.broadcast(near), "line", "left_semi") if near.count() <= SMALL_ROWS else some.distinct().join(near, "line", "left_semi")
    exact = some.distinct().groupBy("line").agg((F.count("*") >= min_sites).alias("spread"))
    told = found.join(exact, "line", "left").withColumn("spread", F.coalesce("spread", F.col("sites") > min_sites + error, F.lit(False)))
    return told.where(F.col("spread") | F.col("long") & (F.col("first") < F.col("last"))).select("line", F.when(~F.col("spread"), F.col("first")).alias("first"))


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", site_column: str = "source", text_column: str = "text", min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, over_classes: bool = False, counts: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the lines removed that repeated_lines finds; counts names two columns, lines of each text and how many it lost.

    Columns of docs that have those names give way to the counts; without counts, all of them stay.
    """
    rows = _told_apart(docs, id_column, site_column, text_column, over_classes)
    repeated = kept(repeated_lines(rows, min_sites, long_words), "lines-to-remove")
    places = rows.select("key", "own", F.posexplode(_lines(F.col("text"))).alias("place", "line")).where(F.col("line").rlike(_WORD))
    hits = _with_line(places.select("key", "own", "place", _key(F.col("line")).alias("line")), repeated, "inner").where("first is null or first <> own")
    gone = kept(hits.groupBy("key").agg(F.collect_set("place").alias("gone")), "removed-lines")
    n = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    joined = rows.select("key", "text", "row").join(F.broadcast(gone) if n <= 2 * SMALL_ROWS else gone, "key", "left")
    left = F.array_join(F.filter(_lines(F.col("text")), lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNotNull(), left).otherwise(F.col("text"))
    columns = [(text if c == text_column else F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        columns += [F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("bigint").alias(counts[0]), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias(counts[1])]
    return joined.select(*columns)


def op8_spread_lines(spark, sf_dir: str) -> DataFrame:
    cleaned = without_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = f"""
WITH t AS (SELECT text, min(doc_id) AS own, arg_min(source, doc_id) AS site FROM documents WHERE text IS NOT NULL GROUP BY 1),
k AS (SELECT trim(line) AS line, count(DISTINCT site) AS sites, min(own) AS first, max(own) AS last FROM (SELECT own, site, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
b AS (SELECT line, CASE WHEN sites < {MIN_SITES} THEN first END AS first FROM k WHERE sites >= {MIN_SITES} OR first < last AND len(regexp_extract_all(line, '{_WORD}')) >= {LONG_WORDS}),
p AS (SELECT own, i AS place, lines[i] AS line FROM (SELECT own, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT own, string_split(text, chr(10)) AS lines FROM t))),
m AS (SELECT p.own, place, p.line, b.line IS NOT NULL AND (b.first IS NULL OR b.first <> p.own) AS gone FROM p LEFT JOIN b ON b.line = trim(p.line) AND regexp_matches(p.line, '{_WORD}')),
g AS (SELECT own, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept FROM m GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(kept) AS n_chars, sha256(kept) AS text_sha256
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN g ON g.own = t.own
"""
