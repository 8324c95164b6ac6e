"""Mail-shaped views of general tables: a document is a message, an event its receipt, a label its tags.

Each view stands here twice: as a DataFrame, and as the SQL of the same rows (a common table expression).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import epoch_ms, hash53, scoped_id

#: The time that windows end at: 2024-01-31T00:00:00Z.
NOW = 1706659200000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def envelopes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every message; seq orders the versions of an id."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    labels = table(spark, sf_dir, "labels")
    joined = d.join(e, d["doc_id"] == e["event_id"]).join(labels, "doc_id", "left")
    account = F.substring("source", 4, 9).cast("bigint")
    message_id = F.concat(F.md5("text"), F.lit("@fixture"))
    bought = F.col("event_type") == "purchase"
    date = epoch_ms(F.col("ts"))
    return joined.select(
        scoped_id(account, message_id).alias("id"),
        account.alias("account_id"),
        scoped_id(account, F.col("lang")).alias("mailbox_id"),
        F.col("lang").alias("mailbox_name"),
        F.col("doc_id").alias("uid"),
        F.col("doc_id").alias("seq"),
        F.substring_index("text", "\n", 1).alias("subject"),
        "text",
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("from"),
        F.array(F.concat(F.lit("user"), ((F.col("user_id") + 1) % 150).cast("string"), F.lit("@example.org"))).alias("to"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("list@example.org"))).otherwise(F.array().cast("array<string>")).alias("cc"),
        F.array().cast("array<string>").alias("bcc"),
        date.alias("date"),
        date.alias("internal_date"),
        F.octet_length("text").cast("bigint").alias("size"),
        hash53(message_id).alias("thread_id"),
        message_id.alias("message_id"),
        F.when(bought, F.array(F.concat(F.lit("report-"), F.get_json_object("props", "$.k"), F.lit(".pdf")))).otherwise(F.array().cast("array<string>")).alias("attachments"),
        bought.alias("has_attachment"),
        _compact(F.when(F.col("quality") == 1, "/quality/high").when(F.col("quality") == 0, "/quality/low"), F.when(F.col("toxic") == 1, "/safety/toxic")).alias("tags"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each message."""
    latest = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return envelopes_all(spark, sf_dir).withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three accounts in four have a row; the number is its own id."""
    ids = table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("bigint").alias("id")).distinct().where("id % 4 <> 3")
    return ids.select("id", F.concat(F.lit("account"), "id", F.lit("@example.org")).alias("email"), (F.col("id") % 5 != 0).alias("enabled"), (F.col("id") % 7).alias("created_by"), (F.lit(NOW) - F.col("id") * 86400000).alias("created_at"), (10 + F.col("id") * 5).cast("bigint").alias("sync_interval_min"))


def mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir)
    return e.groupBy("account_id", F.col("mailbox_id").alias("id"), F.col("mailbox_name").alias("name")).agg(F.count("*").alias("exists")).withColumn("uid_validity", F.lit(1).cast("bigint"))


def mailboxes_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders as a server has them: one in five renamed, one in seven with another validity, one in eleven with none."""
    m = mailboxes(spark, sf_dir)
    renamed = F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("-new"))).otherwise(F.col("name"))
    return m.select("account_id", renamed.alias("name"), "exists", F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 7 == 0, 2).otherwise(1).cast("bigint").alias("uid_validity"), (F.col("id") % 3 == 0).alias("subscribed"), F.when(F.col("id") % 13 == 0, "\\Noselect").when(F.col("id") % 4 == 0, "\\Sent").otherwise("\\HasNoChildren").alias("flag"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User k has the role k % 4 on the accounts k % 20 and (k + 7) % 20, and one user in ten a global role."""
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    role = F.when(F.col("id") % 2 == 0, 200_100_000_000_000).otherwise(200_200_000_000_000).cast("bigint")
    glob = F.when(F.col("id") % 10 == 0, F.array(F.lit(100_000_000_000_000).cast("bigint"))).when(F.col("id") % 3 == 0, F.array(F.lit(100_200_000_000_000).cast("bigint"), F.lit(999).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return u.select("id", F.concat(F.lit("user"), "id").alias("username"), F.concat(F.lit("user"), "id", F.lit("@example.org")).alias("email"), glob.alias("global_roles"), F.map_from_arrays(F.array(F.col("id") % 20, (F.col("id") + 7) % 20), F.array(role, role)).alias("account_access_map"))


def threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as messages that answer each other."""
    c = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn)
    return c.select(
        "conv_id",
        "turn",
        (F.col("conv_id") % 7).alias("account_id"),
        F.col("role").alias("from"),
        "text",
        name(F.col("turn").cast("string")).alias("message_id"),
        F.when(F.col("turn") > 0, name((F.col("turn") - 1).cast("string"))).alias("in_reply_to"),
        F.when(F.col("turn") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("turn") - 1), lambda t: name(t.cast("string")))).otherwise(F.array().cast("array<string>")).alias("references"),
    )


_H = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT)"
SQL = {
    "ea": f"""ea AS (SELECT {_H.format("account_id || ':' || message_id")} AS id, account_id, {_H.format("account_id || ':' || lang")} AS mailbox_id, lang AS mailbox_name, doc_id AS uid, doc_id AS seq,
 split_part(text, chr(10), 1) AS subject, text, 'user' || user_id || '@example.org' AS "from", ['user' || ((user_id + 1) % 150) || '@example.org'] AS "to", CASE WHEN doc_id % 3 = 0 THEN ['list@example.org'] ELSE [] END AS cc, CAST([] AS VARCHAR[]) AS bcc,
 epoch_us(ts) // 1000 AS "date", epoch_us(ts) // 1000 AS internal_date, CAST(strlen(text) AS BIGINT) AS size, {_H.format("message_id")} AS thread_id, message_id,
 CASE WHEN event_type = 'purchase' THEN ['report-' || json_extract_string(props, '$.k') || '.pdf'] ELSE [] END AS attachments, event_type = 'purchase' AS has_attachment,
 list_filter([CASE WHEN quality = 1 THEN '/quality/high' WHEN quality = 0 THEN '/quality/low' END, CASE WHEN toxic = 1 THEN '/safety/toxic' END], lambda x: x IS NOT NULL) AS tags
 FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS account_id, md5(text) || '@fixture' AS message_id FROM documents JOIN events ON doc_id = event_id LEFT JOIN labels USING (doc_id)))""",
    "e": "e AS (SELECT * FROM ea QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)",
    "acc": f"acc AS (SELECT id, 'account' || id || '@example.org' AS email, id % 5 <> 0 AS enabled, id % 7 AS created_by, {NOW} - id * 86400000 AS created_at, 10 + id * 5 AS sync_interval_min FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id FROM documents) WHERE id % 4 <> 3)",
    "mb": "mb AS (SELECT account_id, mailbox_id AS id, mailbox_name AS name, count(*) AS \"exists\", 1 AS uid_validity FROM e GROUP BY ALL)",
    "mr": "mr AS (SELECT account_id, CASE WHEN id % 5 = 0 THEN name || '-new' ELSE name END AS name, \"exists\", CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN 2 ELSE 1 END AS uid_validity, id % 3 = 0 AS subscribed, CASE WHEN id % 13 = 0 THEN '\\Noselect' WHEN id % 4 = 0 THEN '\\Sent' ELSE '\\HasNoChildren' END AS flag FROM mb)",
    "u": "u AS (SELECT id, 'user' || id AS username, 'user' || id || '@example.org' AS email, CASE WHEN id % 2 = 0 THEN 200100000000000 ELSE 200200000000000 END AS role, id % 20 AS a1, (id + 7) % 20 AS a2 FROM (SELECT DISTINCT user_id AS id FROM events))",
    "th": "th AS (SELECT conv_id, turn, conv_id % 7 AS account_id, role AS \"from\", text, conv_id || ':' || turn AS message_id, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS in_reply_to, CASE WHEN turn > 0 THEN conv_id || ':0' END AS first_reference FROM conversations)",
}
_NEEDS = {"e": ["ea"], "mb": ["ea", "e"], "mr": ["ea", "e", "mb"]}


def sql(body: str, *views: str) -> str:
    """A statement on some of the views."""
    wanted: list[str] = []
    for v in views:
        wanted += [x for x in [*_NEEDS.get(v, []), v] if x not in wanted]
    return "WITH " + ",\n".join(SQL[v] for v in wanted) + ("\n" + body if not body.lstrip().startswith(",") else body)
