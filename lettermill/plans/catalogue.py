"""Registered queries of the mail archive over the mail-shaped views, each with SQL that gives the same rows."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fixtures as X
from ..functions import columns as C
from ..operators import access, aggregates, folders, ingest, maintenance, snapshots
from ..operators import search as S
from ..sources import eml, mail_files
from ..streaming import deltas, planner
from ..streaming import ingest as stream
from . import layouts, living_index, token_index
from .scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = X.NOW


def query(name: str, body: str | None = None, *views: str):
    """Registers a function of (spark, sf_dir) and its SQL on some of the views."""

    def register(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = X.sql(body, *views) if views else body
        return f

    return register


_IDS = ["id", "uid", "date"]
_TOK = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) <= 40)"
_ALL = "concat_ws(chr(10), subject, text, array_to_string(attachments, chr(10)))"
_H = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT)"


def _search(name: str, where: str, criteria: S.Search, accounts: list[int] | None = None) -> None:
    query(name, f'SELECT id, uid, "date" FROM e WHERE {where}', "e")(lambda s, d: S.search(X.envelopes(s, d), criteria, accounts).select(*_IDS))


# ---------------------------------------------------------------- filters

_search("f01_scope_some", "account_id IN (1, 4, 6)", S.Search(), [1, 4, 6])
_search("f01_scope_all", "true", S.Search())
_search("f01_scope_none", "false", S.Search(), [])
_search("f02_full_text_all", f"list_has_all({_TOK.format(_ALL)}, ['the', 'and'])", S.Search(all_words="The and"))
_search("f02_full_text_any_none", f"list_has_any({_TOK.format(_ALL)}, ['licensed', 'released']) AND NOT list_has_any({_TOK.format(_ALL)}, ['apache'])", S.Search(any_words="licensed released", no_words="apache"))
_search("f02_full_text_phrase", f"contains(' ' || array_to_string({_TOK.format(_ALL)}, ' ') || ' ', ' all rights reserved ')", S.Search(phrase="All rights reserved"))
_search("f03_tags_any", "list_has_any(tags, ['/quality/high', '/quality/low'])", S.Search(tags=["/quality"]))
_search("f03_tag_exact", "list_contains(tags, '/safety/toxic')", S.Search(tags=["/safety/toxic"]))
_search("f04_sender", "\"from\" = 'user7@example.org'", S.Search(sender="user7@example.org"))
_search("f05_recipients", "list_contains(\"to\", 'user8@example.org') AND list_contains(cc, 'list@example.org')", S.Search(to="user8@example.org", cc="list@example.org"))
_search("f05_bcc", "list_contains(bcc, 'x@example.org')", S.Search(bcc="x@example.org"))
_search("f06_has_attachment", "has_attachment", S.Search(has_attachment=True))
_search("f06_false_is_ignored", "true", S.Search(has_attachment=False))
_search("f07_attachment_name", f"len(list_filter(attachments, lambda a: list_contains({_TOK.format('a')}, 'report'))) > 0", S.Search(attachment_name="Report"))
_search("f08_dates", '"date" BETWEEN 1704500000000 AND 1705500000000', S.Search(since=1704500000000, before=1705500000000))
_search("f09_account", "account_id = 3", S.Search(account_id=3))
_search("f10_mailbox", f"mailbox_id = {_H.format(repr('3:en'))}", S.Search(mailbox_id=int(hashlib.md5(b"3:en").hexdigest()[:13], 16)))
_search("f11_sizes", "size BETWEEN 500 AND 2000", S.Search(min_size=500, max_size=2000))
_search("f12_message_id", f"message_id = {repr(hashlib.md5(b'x').hexdigest() + '@fixture')}", S.Search(message_id=hashlib.md5(b"x").hexdigest() + "@fixture"))
_search("f13_size_preset", "size <= 15360", S.Search(size_preset="tiny"))
_search("f14_blanks_are_dropped", "true", S.Search(sender=" ", tags=[], all_words=""))


@query("f13_size_buckets", "SELECT CASE WHEN size <= 15360 THEN 'tiny' WHEN size <= 2097152 THEN 'small' WHEN size < 20971520 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM e GROUP BY 1", "e")
def _(s, d):
    return X.envelopes(s, d).groupBy(C.size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n"))


_INDEXES: dict[tuple[str, str], str] = {}


def _index(s, d):
    """The index of all messages, written once for a table and application; look-ups then open the parts of their words."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = scratch(s, "index")
        token_index.write(X.envelopes(s, d), path)
        _INDEXES[key] = path
    return token_index.read(s, _INDEXES[key])


@query("f15_index_search", f"SELECT id FROM e WHERE list_has_all({_TOK.format(_ALL)}, ['rights', 'reserved'])", "e")
def _(s, d):
    return token_index.with_all(_index(s, d), ["rights", "reserved"])


@query(
    "f15_index_backed_search",
    f"SELECT id, uid, \"date\" FROM e WHERE size >= 300 AND ((list_has_any({_TOK.format(_ALL)}, ['licensed', 'released']) AND NOT list_has_any({_TOK.format(_ALL)}, ['apache'])) OR (list_has_all({_TOK.format(_ALL)}, ['the', 'and']) AND contains(' ' || array_to_string({_TOK.format(_ALL)}, ' ') || ' ', ' all rights reserved ')))",
    "e",
)
def _(s, d):
    e, index = X.envelopes(s, d), _index(s, d)
    one = token_index.search(e, index, S.Search(any_words="licensed released", no_words="Apache", min_size=300))
    two = token_index.search(e, index, S.Search(all_words="the and", phrase="All rights reserved", min_size=300))
    return one.union(two).select(*_IDS).distinct()


@query("f15_index_postings", f"SELECT token, count(*) AS n_messages, sum(n)::BIGINT AS n_positions FROM (SELECT id, token, field, count(*) AS n FROM (SELECT id, 'subject' AS field, unnest({_TOK.format('subject')}) AS token FROM e UNION ALL SELECT id, 'text', unnest({_TOK.format('text')}) FROM e UNION ALL SELECT id, 'attachments', unnest({_TOK.format('array_to_string(attachments, chr(10))')}) FROM e) GROUP BY ALL) GROUP BY 1", "e")
def _(s, d):
    return token_index.postings(X.envelopes(s, d)).groupBy("token").agg(F.count("*").alias("n_messages"), F.sum(F.size("positions")).alias("n_positions"))


@query("f16_tokens", f"SELECT doc_id, len({_TOK.format('text')}) AS n FROM documents")
def _(s, d):
    return X.table(s, d, "documents").select("doc_id", F.size(C.tokens(F.col("text"))).cast("bigint").alias("n"))


# ---------------------------------------------------------------- reads, sorting and paging

_PREVIEW = "CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END"


@query(
    "q01_search_page",
    f"SELECT p.id, p.account_id, p.uid, p.\"from\", p.\"date\", p.size, p.preview, acc.email AS account_email, mb.name AS mailbox_name FROM (SELECT *, {_PREVIEW} AS preview FROM e WHERE account_id IN (0, 1, 2, 3, 5) AND \"date\" >= 1704100000000 AND size BETWEEN 100 AND 100000 ORDER BY \"date\" DESC, id LIMIT 50 OFFSET 50) p LEFT JOIN acc ON acc.id = p.account_id LEFT JOIN mb ON mb.account_id = p.account_id AND mb.id = p.mailbox_id",
    "e",
    "acc",
    "mb",
)
def search_page(s, d):
    """The flagship: a scoped search, its second page, with names and previews."""
    found = S.result_page(X.envelopes(s, d), S.Search(since=1704100000000, min_size=100, max_size=100000), 2, 50, X.accounts(s, d), X.mailboxes(s, d), [0, 1, 2, 3, 5])
    return found.select("id", "account_id", "uid", "from", "date", "size", "preview", "account_email", "mailbox_name")


@query("q02_folder_listing", 'SELECT id, uid, "date" FROM e WHERE account_id = 0 AND mailbox_name = \'en\' ORDER BY "date" DESC, id LIMIT 20', "e")
def _(s, d):
    return S.page(X.envelopes(s, d).where("account_id = 0 and mailbox_name = 'en'"), 1, 20).select(*_IDS)


@query("q03_thread_listing", f"SELECT conv_id, turn, {_H.format('coalesce(first_reference, message_id)')} AS thread_id FROM th WHERE account_id = 0 AND {_H.format('coalesce(first_reference, message_id)')} = {_H.format(repr('7:0'))}", "th")
def _(s, d):
    t = X.threaded(s, d).withColumn("thread_id", C.thread_id(F.col("in_reply_to"), F.col("references"), F.col("message_id")))
    return S.page(t.where((F.col("account_id") == 0) & (F.col("thread_id") == C.hash53(F.lit("7:0")))), 1, 1000, by="turn", key="message_id", limit_size=False).select("conv_id", "turn", "thread_id")


@query("q04_envelope_by_id", "SELECT e.id, e.uid FROM e WHERE id IN (SELECT id FROM ea WHERE has_attachment)", "e")
def _(s, d):
    wanted = X.envelopes_all(s, d).where("has_attachment").select("id").distinct()
    return X.envelopes(s, d).join(wanted, "id", "left_semi").select("id", "uid")


def _raw(s, d):
    """The raw log of all messages: their latest bytes."""
    return maintenance.latest(X.envelopes_all(s, d).select("id", "account_id", "mailbox_id", F.encode("text", "UTF-8").alias("eml"), "seq")).drop("seq")


@query("q05_raw_by_id", "SELECT id, sha256(text) AS eml_sha256 FROM e WHERE account_id = 2 AND id = (SELECT min(id) FROM e WHERE account_id = 2)", "e")
def _(s, d):
    raw = _raw(s, d)
    wanted = raw.where("account_id = 2").agg(F.min("id")).scalar()
    return raw.where((F.col("account_id") == 2) & (F.col("id") == wanted)).select("id", F.sha2("eml", 256).alias("eml_sha256"))


@query("q06_reading_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM th", "th")
def _(s, d):
    return X.threaded(s, d).select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("place"))


@query("q07_folders_of_account", 'SELECT id, name, "exists" FROM mb WHERE account_id = 4', "mb")
def _(s, d):
    return X.mailboxes(s, d).where("account_id = 4").select("id", "name", "exists")


@query("q08_account_list", "SELECT acc.id, acc.email, coalesce(u.username, 'Unknown') AS creator, coalesce(u.email, 'N/A') AS creator_email FROM acc LEFT JOIN u ON u.id = acc.created_by WHERE acc.id IN (0, 1, 2, 4, 6, 9) ORDER BY created_at LIMIT 5", "acc", "u")
def _(s, d):
    a = S.page(X.accounts(s, d).where(S.in_scope([0, 1, 2, 4, 6, 9], "id")), 1, 5, descending=False, by="created_at")
    u = X.users(s, d).select(F.col("id").alias("created_by"), "username", F.col("email").alias("creator"))
    return a.join(u, "created_by", "left").select("id", "email", F.coalesce("username", F.lit("Unknown")).alias("creator"), F.coalesce("creator", F.lit("N/A")).alias("creator_email"))


@query("l01_page_totals", "SELECT count(*) AS total_items, CAST(ceil(count(*) / 30.0) AS BIGINT) AS total_pages FROM e WHERE has_attachment", "e")
def _(s, d):
    return S.totals(X.envelopes(s, d).where("has_attachment"), 30)


@query("l01_page_past_the_end", 'SELECT id, uid, "date" FROM e WHERE false', "e")
def _(s, d):
    return S.page(X.envelopes(s, d), 4000, 500).select(*_IDS)


@query("l01_page_by_key", 'SELECT id, uid, "date" FROM (SELECT * FROM e ORDER BY "date" DESC, id LIMIT 40) EXCEPT SELECT id, uid, "date" FROM (SELECT * FROM e ORDER BY "date" DESC, id LIMIT 20)', "e")
def _(s, d):
    e = X.envelopes(s, d)
    last = S.page_after(e, None, None, 20).agg(F.min(F.struct("date", (-F.col("id")).alias("n"))).alias("last"))
    # The key of the last row seen is one value; the next page starts behind it.
    held = e.withColumn("last", last.select("last").scalar())
    return S.page(held.where("date < last.date or date = last.date and id > -last.n"), 1, 20).select(*_IDS)


@query("l03_unpaged", 'SELECT id, uid, "date" FROM e WHERE account_id = 5', "e")
def _(s, d):
    return S.page(X.envelopes(s, d).where("account_id = 5")).select(*_IDS)


@query("l04_largest", "SELECT id, subject, size FROM e ORDER BY size DESC, id LIMIT 10", "e")
def _(s, d):
    return aggregates.largest(X.envelopes(s, d))


@query("l05_ascending", 'SELECT id, uid, "date" FROM e ORDER BY "date", id LIMIT 25', "e")
def _(s, d):
    return S.page(X.envelopes(s, d), 1, 25, descending=False).select(*_IDS)


for _name, _newest in (("l06_newest_of_folder", True), ("l06_oldest_of_folder", False)):
    query(_name, f"SELECT account_id, mailbox_id, uid FROM ea QUALIFY row_number() OVER (PARTITION BY account_id, mailbox_id ORDER BY uid {'DESC' if _newest else 'ASC'}) <= 100", "ea")(lambda s, d, newest=_newest: ingest.first_n(X.envelopes_all(s, d), 10, newest).select("account_id", "mailbox_id", "uid"))


# ---------------------------------------------------------------- aggregates


@query("a01_email_count", "SELECT count(*) AS n FROM e WHERE account_id IN (1, 2)", "e")
def _(s, d):
    return X.envelopes(s, d).where(S.in_scope([1, 2])).agg(F.count("*").alias("n"))


@query("a02_a06_a07_scalars", "SELECT count(*) AS email_count, coalesce(sum(size), 0)::BIGINT AS total_size, count(*) FILTER (has_attachment) AS with_attachment, count(*) FILTER (NOT has_attachment) AS without_attachment, coalesce(count(*) FILTER (has_attachment) / nullif(count(*), 0), 0.0) AS attachment_ratio FROM e", "e")
def _(s, d):
    return aggregates.scalars(X.envelopes(s, d))


@query("a03_daily_activity", f'SELECT c.day, count(e.id) AS n FROM (SELECT unnest(range({NOW // 86400000 - 30}, {NOW // 86400000 + 1})) * 86400000 AS day) c LEFT JOIN (SELECT * FROM e WHERE "date" BETWEEN {NOW - 30 * 86400000} AND {NOW}) e ON e."date" // 86400000 * 86400000 = c.day GROUP BY 1', "e")
def _(s, d):
    return aggregates.daily_activity(X.envelopes(s, d), NOW)


@query("a04_top_senders", 'SELECT "from", count(*) AS n FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10', "e")
def _(s, d):
    return aggregates.top(X.envelopes(s, d), "from")


@query("a05_top_accounts", "SELECT t.account_id, n, acc.email FROM (SELECT account_id, count(*) AS n FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t LEFT JOIN acc ON acc.id = t.account_id", "e", "acc")
def _(s, d):
    return aggregates.top_accounts(X.envelopes(s, d), X.accounts(s, d))


@query("a08_max_uid", "SELECT account_id, mailbox_id, max(uid) AS max_uid FROM e GROUP BY ALL", "e")
def _(s, d):
    return aggregates.max_uid(X.envelopes(s, d))


@query("a09_folder_counts", "SELECT account_id, mailbox_id, count(*) AS n FROM e GROUP BY ALL", "e")
def _(s, d):
    return X.envelopes(s, d).groupBy("account_id", "mailbox_id").agg(F.count("*").alias("n"))


@query("a10_thread_counts", f"SELECT account_id, {_H.format('coalesce(first_reference, message_id)')} AS thread_id, count(*) AS n FROM th GROUP BY ALL", "th")
def _(s, d):
    t = C.thread_id(F.col("in_reply_to"), F.col("references"), F.col("message_id"))
    return X.threaded(s, d).groupBy("account_id", t.alias("thread_id")).agg(F.count("*").alias("n"))


_FACETS = "SELECT path, count(DISTINCT id) AS n FROM (SELECT id, unnest([regexp_extract(tag, '^/[^/]+'), tag]) AS path FROM (SELECT id, unnest(tags) AS tag FROM e)) GROUP BY 1"


@query("a11_facets", _FACETS, "e")
def _(s, d):
    return aggregates.facets(X.envelopes(s, d))


@query("a12_popular_facets", _FACETS + " ORDER BY n DESC, path LIMIT 3", "e")
def _(s, d):
    return aggregates.facets(X.envelopes(s, d)).orderBy(F.col("n").desc(), "path").limit(3)


@query("a13_account_count", "SELECT count(*) AS n FROM acc", "acc")
def _(s, d):
    return X.accounts(s, d).agg(F.count("*").alias("n"))


@query("a13_scope_size", "SELECT u.id AS user_id, count(DISTINCT acc.id) AS n FROM u, acc WHERE u.id IN (7, 10) AND (u.id % 10 = 0 OR acc.id IN (a1, a2)) GROUP BY 1", "acc", "u")
def _(s, d):
    scope = access.read_scope(X.users(s, d), access.builtin_roles(s))
    sizes = [access.scope_size(scope, X.accounts(s, d), k).select(F.lit(k).cast("bigint").alias("user_id"), "n") for k in (7, 10)]
    return sizes[0].union(sizes[1]).where("n > 0")


def _dashboard_sql(e: str, acc: str) -> str:
    return (
        f"SELECT 'count' AS part, '' AS key, count(*) AS n FROM {e} UNION ALL SELECT 'size', '', coalesce(sum(size), 0)::BIGINT FROM {e} UNION ALL SELECT 'with_attachment', '', count(*) FILTER (has_attachment) FROM {e} UNION ALL SELECT 'without_attachment', '', count(*) FILTER (NOT has_attachment) FROM {e} "
        f"UNION ALL SELECT 'accounts', '', count(*) FROM {acc} UNION ALL SELECT 'stored', '', 0 UNION ALL SELECT 'activity', CAST(c.day AS VARCHAR), count(e.id) FROM (SELECT unnest(range({NOW // 86400000 - 30}, {NOW // 86400000 + 1})) * 86400000 AS day) c LEFT JOIN (SELECT * FROM {e} WHERE \"date\" BETWEEN {NOW - 30 * 86400000} AND {NOW}) e ON e.\"date\" // 86400000 * 86400000 = c.day GROUP BY c.day "
        f"UNION ALL (SELECT 'sender', \"from\", count(*) FROM {e} GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL (SELECT 'account', CAST(account_id AS VARCHAR), count(*) FROM {e} GROUP BY account_id ORDER BY 3 DESC, account_id LIMIT 10) UNION ALL (SELECT 'largest', CAST(id AS VARCHAR), size FROM {e} ORDER BY size DESC, id LIMIT 10)"
    )


@query("a14_dashboard", _dashboard_sql("e", "acc"), "e", "acc")
def _(s, d):
    return aggregates.dashboard_rows(aggregates.dashboard(X.envelopes(s, d), X.accounts(s, d), NOW))


@query("a14_scoped_dashboard", ", se AS (SELECT * FROM e WHERE account_id IN (SELECT unnest([a1, a2]) FROM u WHERE id = 7)), sa AS (SELECT * FROM acc WHERE id IN (SELECT unnest([a1, a2]) FROM u WHERE id = 7)) " + _dashboard_sql("se", "sa"), "e", "acc", "u")
def _(s, d):
    scope = access.read_scope(X.users(s, d), access.builtin_roles(s))
    mine = access.scoped(X.accounts(s, d).withColumn("account_id", F.col("id")), scope, 7).drop("account_id")
    stored = eml.stored_bytes(s, d, scoped=True)
    return aggregates.dashboard_rows(aggregates.dashboard(access.scoped(X.envelopes(s, d), scope, 7), mine, NOW, stored))


@query("p18_stored_bytes")
def _(s, d):
    return eml.stored_bytes(s, d)


@query("a15_activity_rollup", 'SELECT account_id, "from", count(*) AS n FROM e GROUP BY ROLLUP (account_id, "from")', "e")
def _(s, d):
    return aggregates.activity_rollup(X.envelopes(s, d))


# ---------------------------------------------------------------- joins and sets


@query("j01_j02_names", "SELECT e.id, acc.email AS account_email, mb.name AS mailbox_name FROM e LEFT JOIN acc ON acc.id = e.account_id LEFT JOIN mb ON mb.account_id = e.account_id AND mb.id = e.mailbox_id", "e", "acc", "mb")
def _(s, d):
    return S.with_names(X.envelopes(s, d), X.accounts(s, d), X.mailboxes(s, d)).select("id", "account_email", "mailbox_name")


@query("j03_envelope_and_raw", "SELECT id, uid, length(text) AS n_chars FROM e", "e")
def _(s, d):
    raw = _raw(s, d).select("id", "eml")
    return X.envelopes(s, d).select("id", "uid").join(raw, "id").select("id", "uid", F.length(F.decode("eml", "UTF-8")).cast("bigint").alias("n_chars"))


for _name, _sql, _op in (
    ("j04_known_folders", "SELECT account_id, name FROM mr WHERE (account_id, name) IN (SELECT (account_id, name) FROM mb)", folders.known),
    ("j05_o01_new_folders", "SELECT account_id, name FROM mr WHERE (account_id, name) NOT IN (SELECT (account_id, name) FROM mb)", folders.new),
    ("o02_deleted_folders", "SELECT account_id, name FROM mb WHERE (account_id, name) NOT IN (SELECT (account_id, name) FROM mr)", folders.gone),
):
    query(_name, _sql, "mb", "mr")(lambda s, d, op=_op: op(X.mailboxes_remote(s, d), X.mailboxes(s, d)).select("account_id", "name"))


@query("o03_pruned_subscriptions", "SELECT account_id, name FROM mb WHERE \"exists\" > 2 AND (account_id, name) IN (SELECT (account_id, name) FROM mr)", "mb", "mr")
def _(s, d):
    local, remote = X.mailboxes(s, d), X.mailboxes_remote(s, d)
    subscribed = local.where("exists > 2")
    return subscribed.join(folders.gone(remote, local), ["account_id", "name"], "left_anti").select("account_id", "name")


@query("o04_request_ids", "SELECT DISTINCT user_id AS id FROM events")
def _(s, d):
    return maintenance.deduplicated(X.table(s, d, "events").select(F.col("user_id").alias("id")))


_GRANTS = "g AS (SELECT id AS user_id, unnest([CASE WHEN id % 10 = 0 THEN 100000000000000 WHEN id % 3 = 0 THEN 100200000000000 END, CASE WHEN id % 10 <> 0 AND id % 3 = 0 THEN 999 END]) AS role_id, CAST(NULL AS BIGINT) AS account_id FROM u UNION ALL SELECT id, role, unnest([a1, a2]) FROM u)"
_ROLES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({access.ROLE_IDS[k]}, '{k}', '{p}')" for k, ps in access.ROLE_PERMISSIONS.items() for p in ps) + ") AS t(role_id, name, permission))"


@query("j06_account_creator", "SELECT acc.id, coalesce(u.username, 'Unknown') AS creator FROM acc LEFT JOIN u ON u.id = acc.created_by", "acc", "u")
def _(s, d):
    u = X.users(s, d).select(F.col("id").alias("created_by"), "username")
    return X.accounts(s, d).join(u, "created_by", "left").select("id", F.coalesce("username", F.lit("Unknown")).alias("creator"))


@query("j07_r05_user_roles", f", {_GRANTS}, {_ROLES} SELECT g.user_id, g.account_id, coalesce(n.name, 'Unknown Role') AS role_name FROM g LEFT JOIN (SELECT DISTINCT role_id, name FROM r) n ON n.role_id = g.role_id WHERE g.role_id IS NOT NULL", "u")
def _(s, d):
    r = access.builtin_roles(s).select(F.col("id").alias("role_id"), F.col("name").alias("role_name"))
    return access.grants(X.users(s, d)).join(r, "role_id", "left").select("user_id", "account_id", F.coalesce("role_name", F.lit("Unknown Role")).alias("role_name"))


# ---------------------------------------------------------------- access


@query("r01_permissions", f", {_GRANTS}, {_ROLES} SELECT DISTINCT g.user_id, g.account_id, r.permission FROM g JOIN r ON r.role_id = g.role_id", "u")
def _(s, d):
    return access.permissions(X.users(s, d), access.builtin_roles(s))


@query("r02_allowed", "SELECT id AS user_id, id % 20 AS account_id, p AS permission, id % 10 = 0 OR id % 2 = 0 OR p IN ('data:read', 'account:read_details') AS allowed FROM u, (SELECT unnest(['data:read', 'data:delete', 'account:read_details']) AS p)", "u")
def _(s, d):
    u = X.users(s, d)
    asked = u.select(F.col("id").alias("user_id"), (F.col("id") % 20).alias("account_id"), F.explode(F.array(*map(F.lit, ["data:read", "data:delete", "account:read_details"]))).alias("permission"))
    return access.allowed(asked, u, access.builtin_roles(s))


@query("r03_read_scope", "SELECT id AS user_id, NULL::BIGINT AS account_id, true AS everything FROM u WHERE id % 10 = 0 UNION SELECT id, unnest([a1, a2]), false FROM u", "u")
def _(s, d):
    return access.read_scope(X.users(s, d), access.builtin_roles(s))


@query("r03_scoped_counts", "SELECT k.id AS user_id, account_id, count(*) AS n FROM e, (SELECT * FROM u WHERE id IN (7, 10)) k WHERE k.id % 10 = 0 OR account_id IN (a1, a2) GROUP BY ALL", "e", "u")
def _(s, d):
    scope = access.read_scope(X.users(s, d), access.builtin_roles(s))
    counts = [access.scoped(X.envelopes(s, d), scope, k).groupBy("account_id").agg(F.count("*").alias("n")).select(F.lit(k).cast("bigint").alias("user_id"), "account_id", "n") for k in (7, 10)]
    return counts[0].union(counts[1])


@query("r04_wrong_permissions", "SELECT id AS role_id, 'system:root' AS permission FROM u WHERE id % 2 = 1 UNION ALL SELECT id, 'data:read' FROM u WHERE id % 2 = 0", "u")
def _(s, d):
    roles = X.users(s, d).select("id", F.when(F.col("id") % 2 == 0, "global").otherwise("account").alias("kind"), F.array(F.lit("system:root"), F.lit("data:read")).alias("permissions"))
    return access.wrong_permissions(roles)


@query("r06_m06_role_grants", "SELECT id AS user_id, a AS account_id, CASE WHEN id IN (1, 2, 3) AND a IN (5, 6) THEN 200200000000000 ELSE role END AS role_id FROM (SELECT id, role, unnest(list_distinct(CASE WHEN id IN (1, 2, 3) THEN [a1, a2, 5, 6] ELSE [a1, a2] END)) AS a FROM u)", "u")
def _(s, d):
    u = maintenance.granted(X.users(s, d), [1, 2, 3], [5, 6], access.ROLE_IDS["account_viewer"])
    return u.select(F.col("id").alias("user_id"), F.explode("account_access_map").alias("account_id", "role_id"))


# ---------------------------------------------------------------- writes


def _log(s, d):
    """Every version upserted; each tenth id deleted at seq + 1/2 of the table, one folder and one account deleted half-way."""
    up = X.envelopes_all(s, d).withColumn("op", F.lit("upsert"))
    half = F.lit(100)
    columns = ["id", "account_id", "mailbox_id", "uid", "size", "tags", "seq", "op"]
    gone = up.where("uid % 10 = 0").select("id", "account_id", "mailbox_id", "uid", "size", "tags", (F.col("seq") + 20).alias("seq"), F.lit("delete").alias("op"))
    box = up.where("account_id = 3 and mailbox_name = 'en'").groupBy("account_id", "mailbox_id").agg(F.min("uid").alias("uid")).select(F.lit(None).cast("bigint").alias("id"), "account_id", "mailbox_id", "uid", F.lit(0).cast("bigint").alias("size"), F.array().cast("array<string>").alias("tags"), half.cast("bigint").alias("seq"), F.lit("delete_mailbox").alias("op"))
    account = box.select("id", F.lit(4).cast("bigint").alias("account_id"), "mailbox_id", "uid", "size", "tags", F.lit(120).cast("bigint").alias("seq"), F.lit("delete_account").alias("op"))
    return up.select(*columns).unionByName(gone).unionByName(box).unionByName(account)


_ALIVE = f"alive AS (SELECT e.* FROM e LEFT JOIN (SELECT id AS gone, max(seq) + 20 AS until FROM ea WHERE uid % 10 = 0 GROUP BY 1) g ON g.gone = e.id WHERE e.seq > coalesce(until, -1) AND NOT (account_id = 3 AND mailbox_name = 'en' AND seq <= 100) AND NOT (account_id = 4 AND seq <= 120 AND EXISTS (SELECT 1 FROM ea WHERE account_id = 3 AND mailbox_name = 'en')))"


@query("s04_upsert", "SELECT id, uid, size FROM e", "e")
def _(s, d):
    return maintenance.latest(X.envelopes_all(s, d)).select("id", "uid", "size")


@query("s05_raw_upsert", "SELECT id, account_id, sha256(text) AS eml_sha256 FROM e", "e")
def _(s, d):
    return _raw(s, d).select("id", "account_id", F.sha2("eml", 256).alias("eml_sha256"))


@query("m02_m03_m04_current_view", f", {_ALIVE} SELECT id, account_id, uid FROM alive", "e")
def _(s, d):
    return maintenance.current(_log(s, d)).select("id", "account_id", "uid")


@query("m01_replaced_tags", f", {_ALIVE} SELECT id, CASE WHEN id IN (SELECT id FROM ea WHERE uid % 7 = 0) THEN '/checked/seven' ELSE array_to_string(tags, ',') END AS tags FROM alive", "e")
def _(s, d):
    tag_log = X.envelopes_all(s, d).where("uid % 7 = 0").select("id", F.array(F.lit("/checked/seven")).alias("tags"), "seq")
    return maintenance.current(_log(s, d), tag_log).select("id", F.array_join("tags", ",").alias("tags"))


@query("m04_deleted_account", "SELECT 'envelopes' AS part, count(*) AS n FROM e WHERE account_id <> 2 UNION ALL SELECT 'accounts', count(*) FROM acc WHERE id <> 2 UNION ALL SELECT 'mailboxes', count(*) FROM mb WHERE account_id <> 2 UNION ALL SELECT 'grants', count(*) FROM (SELECT unnest([a1, a2]) AS a FROM u) WHERE a <> 2", "e", "acc", "mb", "u")
def _(s, d):
    e, empty = X.envelopes(s, d), s.createDataFrame([], "account_id bigint")
    after = maintenance.without_account(2, X.accounts(s, d), X.users(s, d), empty, X.mailboxes(s, d), e, e)
    counted = [after[k].agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k in ("envelopes", "accounts", "mailboxes")]
    grants = after["users"].agg(F.lit("grants").alias("part"), F.sum(F.size("account_access_map")).alias("n"))
    return counted[0].union(counted[1]).union(counted[2]).union(grants)


@query("m05_rebuilt_folder", "SELECT id, CASE WHEN account_id = 1 AND mailbox_name = 'en' THEN size + 1 ELSE size END AS size FROM e WHERE NOT (account_id = 1 AND mailbox_name = 'en') OR uid % 2 = 0", "e")
def _(s, d):
    e = X.envelopes(s, d)
    fresh = e.where("account_id = 1 and mailbox_name = 'en' and uid % 2 = 0").withColumn("size", F.col("size") + 1)
    return maintenance.rebuilt(e, 1, int(hashlib.md5(b"1:en").hexdigest()[:13], 16), fresh).select("id", "size")


@query("m07_clean_tags", "SELECT doc_id, '/a b,/' || lower(lang) AS tags, CASE WHEN doc_id % 3 = 0 THEN 'no leading slash' WHEN doc_id % 3 = 1 THEN 'dangling escape' END AS problem FROM documents")
def _(s, d):
    docs = X.table(s, d, "documents")
    tags = C.clean_tags(F.array(F.lit(" /A b "), F.concat(F.lit("/"), F.upper("lang")), F.lit("/a B")))
    tag = F.when(F.col("doc_id") % 3 == 0, F.lit("plain")).when(F.col("doc_id") % 3 == 1, F.lit("/x\\")).otherwise(F.lit("/x\\\\"))
    return docs.select("doc_id", F.array_join(tags, ",").alias("tags"), C.tag_problem(tag).alias("problem"))


@query("s02_batch_report", "SELECT count(*) AS total, count(*) FILTER (doc_id % 9 <> 0) AS success, count(*) FILTER (doc_id % 9 = 0) AS failed FROM documents")
def _(s, d):
    return eml.batch_report(eml.parse(_messages(s, d)))


@query("s08_restored_bytes", "SELECT e.id, mb.name AS folder, 'ok' AS status, sha256(text) AS eml_sha256 FROM (SELECT * FROM e WHERE account_id = 1 ORDER BY id LIMIT 100) e JOIN mb ON mb.account_id = e.account_id AND mb.id = e.mailbox_id", "e", "mb")
def _(s, d):
    """A restore takes a hundred messages at most."""
    e = X.envelopes(s, d)
    ids = e.where("account_id = 1").select("id").orderBy("id").limit(eml.MOST_RESTORED)
    return eml.restored(ids, e, _raw(s, d), X.mailboxes(s, d)).select("id", "folder", "status", F.sha2("eml", 256).alias("eml_sha256"))


@query("s08_restore", "SELECT i.id, CASE WHEN i.id IS NOT NULL AND e.id IS NOT NULL THEN mb.name END AS folder, CASE WHEN e.id IS NULL THEN 'no_envelope' WHEN e.uid % 2 = 1 THEN 'no_raw' WHEN mb.id IS NULL THEN 'no_folder' ELSE 'ok' END AS status FROM (SELECT DISTINCT id + CASE WHEN uid % 5 = 0 THEN 1 ELSE 0 END AS id FROM e) i LEFT JOIN e ON e.id = i.id LEFT JOIN (SELECT * FROM mb WHERE id % 3 <> 0) mb ON mb.account_id = e.account_id AND mb.id = e.mailbox_id", "e", "mb")
def _(s, d):
    e = X.envelopes(s, d)
    ids = e.select((F.col("id") + F.when(F.col("uid") % 5 == 0, 1).otherwise(0)).alias("id")).distinct()
    return maintenance.restore_status(ids, e, e.where("uid % 2 = 0"), X.mailboxes(s, d).where("id % 3 <> 0"))


# ---------------------------------------------------------------- parsing


def _messages(s, d):
    """Documents as raw messages; each ninth is empty. Text goes in as base64, so that bodies hold any character."""
    docs = X.table(s, d, "documents")
    account = F.substring("source", 4, 9).cast("bigint")
    head = F.concat(
        F.lit("From: Writer <user"), F.col("doc_id").cast("string"), F.lit("@example.org>\r\nTo: A <a@example.org>, Team: b@example.org, c@example.org;\r\nSubject: Message "), F.col("doc_id").cast("string"),
        F.lit("\r\nDate: Wed, 03 Jan 2024 10:00:00 +0000\r\nMessage-ID: <"), F.md5("text"), F.lit("@fixture>\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
    )
    raw = F.encode(F.concat(head, F.base64(F.encode("text", "UTF-8"))), "UTF-8")
    return docs.select(F.col("doc_id").alias("key"), account.alias("account_id"), F.col("lang").alias("mailbox"), F.when(F.col("doc_id") % 9 != 0, raw).alias("eml"))


@query("p01_p02_envelopes", f"SELECT doc_id AS key, {_H.format('source_id || ' + repr(':') + ' || md5(text) || ' + repr('@fixture'))} AS id, 'Message ' || doc_id AS subject, sha256(text) AS text_sha256, 'user' || doc_id || '@example.org' AS sender, 'a@example.org,b@example.org,c@example.org' AS recipients, 1704276000000 AS date FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS source_id FROM documents) WHERE doc_id % 9 <> 0")
def _(s, d):
    good, _ = eml.split_errors(eml.envelopes(_messages(s, d)))
    return good.select("key", "id", "subject", F.sha2("text", 256).alias("text_sha256"), F.col("from").alias("sender"), F.array_join("to", ",").alias("recipients"), "date")


@query("p03_p04_page_text", "SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|head)\\b.*?</(script|style|head)>|<!--.*?-->', '', 'gis'), '</?(p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|footer|header)\\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages")
def _(s, d):
    return X.table(s, d, "pages").select("page_id", C.body_text(F.lit(None).cast("string"), F.col("html")).alias("text"))


@query("p04_parsed_page_text")
def _(s, d):
    return X.table(s, d, "pages").select("page_id", eml.html_text(F.col("html")).alias("text"))


@query("p05_default_message_id", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '<' || sha256(text) || '@generated>' ELSE md5(text) END AS message_id FROM documents")
def _(s, d):
    given = F.when(F.col("doc_id") % 4 != 0, F.md5("text"))
    return X.table(s, d, "documents").select("doc_id", C.default_message_id(given, F.encode("text", "UTF-8")).alias("message_id"))


@query("p06_thread_ids", f"SELECT message_id, {_H.format('coalesce(first_reference, message_id)')} AS thread_id FROM th", "th")
def _(s, d):
    return X.threaded(s, d).select("message_id", C.thread_id(F.col("in_reply_to"), F.col("references"), F.col("message_id")).alias("thread_id"))


@query("p08_repaired_subjects", "SELECT doc_id, 'Re: =?UTF-8?B?' || x || CASE WHEN doc_id % 3 = 0 THEN x ELSE '?= =?' || CASE WHEN doc_id % 3 = 1 THEN 'GBK?B?' ELSE 'UTF-8?Q?' END || x END || '?= end' AS subject FROM (SELECT doc_id, substr(md5(text), 1, 8) AS x FROM documents)")
def _(s, d):
    x = F.substring(F.md5("text"), 1, 8)
    second = F.when(F.col("doc_id") % 3 == 0, "UTF-8?b?").when(F.col("doc_id") % 3 == 1, "GBK?B?").otherwise("UTF-8?Q?")
    subject = F.concat(F.lit("Re: =?UTF-8?B?"), x, F.lit("?= =?"), second, x, F.lit("?= end"))
    return X.table(s, d, "documents").select("doc_id", C.repaired_subject(subject).alias("subject"))


@query("p09_dates", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def _(s, d):
    return X.table(s, d, "events").select("event_id", C.epoch_ms(F.col("ts")).alias("ms"))


@query("p10_ids", f"SELECT doc_id, {_H.format('text')} AS id FROM documents")
def _(s, d):
    return X.table(s, d, "documents").select("doc_id", C.hash53(F.col("text")).alias("id"))


@query("p11_attachments", "SELECT doc_id AS id, 'email' || doc_id || '_attachment0' AS filename, 'application/pdf' AS mime, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def _(s, d):
    return eml.attachments(_with_attachment(s, d)).select("id", "filename", "mime", "size")


@query("p11_nested_mail", "SELECT doc_id AS key, 'outer ' || lang AS text, 'fwd.eml' AS attachments, 'Subject: inner' AS inner_head, md5(text) AS inner_text FROM documents")
def _(s, d):
    """An HTML message with a text message attached: its own text is that of the HTML, and the other one is an attachment."""
    inner = F.concat(F.lit("Subject: inner\r\nContent-Type: text/plain\r\n\r\n"), F.md5("text"))
    head = F.lit('Subject: x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="o"\r\n\r\n--o\r\nContent-Type: text/html\r\n\r\n<p>outer ')
    raw = F.concat(head, "lang", F.lit('</p>\r\n--o\r\nContent-Type: message/rfc822\r\nContent-Disposition: attachment; filename="fwd.eml"\r\n\r\n'), inner, F.lit("\r\n--o--\r\n"))
    docs = X.table(s, d, "documents").select(F.col("doc_id").alias("key"), F.lit(1).cast("bigint").alias("account_id"), F.lit("INBOX").alias("mailbox"), F.encode(raw, "UTF-8").alias("eml"))
    own = eml.envelopes(docs).select("key", "text", F.array_join("attachments", ",").alias("attachments"))
    part = eml.attachments(docs.withColumnRenamed("key", "id")).select(F.col("id").alias("key"), F.decode("data", "UTF-8").alias("data"))
    lines = F.split(F.replace("data", F.lit("\r"), F.lit("")), "\n")
    return own.join(part, "key").select("key", "text", "attachments", F.get(lines, F.lit(0)).alias("inner_head"), F.get(lines, F.lit(3)).alias("inner_text"))


@query("s07_attachment_bytes", "SELECT doc_id AS id, sha256(text) AS data_sha256 FROM documents WHERE doc_id = 17")
def _(s, d):
    return eml.attachment(_with_attachment(s, d), 1, 17, "email17_attachment0").select("id", F.sha2("data", 256).alias("data_sha256"))


def _with_attachment(s, d):
    head = F.lit("Subject: x\r\nMIME-Version: 1.0\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment\r\nContent-Transfer-Encoding: base64\r\n\r\n")
    return X.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("account_id"), F.encode(F.concat(head, F.base64(F.encode("text", "UTF-8"))), "UTF-8").alias("eml"))


@query("p12_embedded_images", "SELECT doc_id, '<img src=\"data:image/png;base64,' || to_base64(encode(md5(text))) || '\"><img src=\"cid:other\">' AS html FROM documents")
def _(s, d):
    inline = F.array(F.struct(F.lit("pic1").alias("content_id"), F.lit("image/png").alias("mime"), F.encode(F.md5("text"), "UTF-8").alias("data")))
    return X.table(s, d, "documents").select("doc_id", C.embedded_images(F.lit('<img src="cid:pic1"><img src="cid:other">'), inline).alias("html"))


@query("p14_previews", f"SELECT doc_id, {_PREVIEW} AS preview FROM documents")
def _(s, d):
    return X.table(s, d, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"))


@query("p15_folder_names", "SELECT lang, 'Entw' || chr(252) || 'rfe/' || lang AS name FROM documents GROUP BY lang")
def _(s, d):
    names = X.table(s, d, "documents").select("lang").distinct()
    coded = names.select("lang", eml.encoded_folder_name(F.concat(F.lit("Entwürfe/"), "lang")).alias("coded"))
    return coded.select("lang", eml.folder_name(F.col("coded")).alias("name"))


@query("p16_folder_flags", "SELECT account_id, name, CASE WHEN flag = '\\Noselect' THEN 'NoSelect' WHEN flag = '\\Sent' THEN 'Sent' ELSE 'Extension' END AS attr, CASE WHEN flag = '\\HasNoChildren' THEN flag END AS extension FROM mr", "mr")
def _(s, d):
    return X.mailboxes_remote(s, d).select("account_id", "name", C.folder_flag(F.col("flag")).alias("f")).select("account_id", "name", "f.attr", "f.extension")


@query("p17_addresses", "SELECT user_id, a AS address, p AS valid FROM (SELECT DISTINCT user_id FROM events), LATERAL (VALUES ('u' || user_id || '@example.org', true), ('u' || user_id || '@', false), ('u..' || user_id || '@example.org', false), ('U ' || user_id || ' <u@example.org>', false)) AS t(a, p)")
def _(s, d):
    x = F.col("user_id").cast("string")
    forms = F.array(F.concat(F.lit("u"), x, F.lit("@example.org")), F.concat(F.lit("u"), x, F.lit("@")), F.concat(F.lit("u.."), x, F.lit("@example.org")), F.concat(F.lit("U "), x, F.lit(" <u@example.org>")))
    return X.table(s, d, "events").select("user_id").distinct().select("user_id", F.explode(forms).alias("address")).withColumn("valid", C.is_email(F.col("address")))


@query("p13_content", "SELECT doc_id AS id, md5(text) AS text, '<img src=\"data:image/png;base64,' || to_base64(encode(lang)) || '\">' AS html, 1 AS n_attachments FROM documents")
def _(s, d):
    part = lambda kind, body, more="": F.concat(F.lit(f"--b\r\nContent-Type: {kind}\r\n{more}\r\n"), body, F.lit("\r\n"))
    head = F.lit('Subject: x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="b"\r\n\r\n')
    image = part("image/png", F.base64(F.encode("lang", "UTF-8")), "Content-ID: <pic1>\r\nContent-Disposition: inline\r\nContent-Transfer-Encoding: base64\r\n")
    raw = F.concat(head, part("text/plain", F.md5("text")), part("text/html", F.lit('<img src="cid:pic1">')), image, F.lit("--b--\r\n"))
    rows = eml.content(X.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.encode(raw, "UTF-8").alias("eml")))
    trimmed = lambda c: F.regexp_replace(c, "[\r\n]+$", "")
    return rows.select("id", trimmed("text").alias("text"), trimmed("html").alias("html"), F.size("attachments").alias("n_attachments"))


@query("s01_base64_batch", "SELECT count(*) AS total, count(*) FILTER (doc_id % 9 <> 0 AND doc_id % 7 <> 0) AS success, count(*) FILTER (doc_id % 9 = 0 OR doc_id % 7 = 0) AS failed FROM documents")
def _(s, d):
    url_safe = F.translate(F.base64("eml"), "+/\r\n", "-_")
    coded = _messages(s, d).withColumn("coded", F.when(F.col("key") % 7 == 0, F.lit("*")).otherwise(url_safe))
    return eml.batch_report(eml.envelopes(coded.withColumn("eml", eml.from_base64(F.col("coded"))).drop("coded")))


@query("s06_export", "SELECT id, sha256(text) AS eml_sha256 FROM e WHERE id IN (SELECT id FROM ea WHERE has_attachment)", "e")
def _(s, d):
    """Raw messages of a set of ids, written out and read again."""
    wanted = X.envelopes_all(s, d).where("has_attachment").select("id")
    return eml.export(_raw(s, d), scratch(s, "export"), wanted).select("id", F.sha2("eml", 256).alias("eml_sha256"))


@query(
    "s01_import_rules",
    "SELECT CASE WHEN a.enabled IS NULL THEN 'unknown account' WHEN NOT a.enabled THEN 'disabled account' WHEN a.id % 2 = 0 AND lang = 'es' THEN 'unknown folder' WHEN doc_id % 9 = 0 THEN 'missing body' ELSE 'ok' END AS outcome, count(*) AS n FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS account_id FROM documents) d LEFT JOIN acc a ON a.id = d.account_id GROUP BY 1 "
    "UNION ALL SELECT 'new folders', count(*) FROM (SELECT DISTINCT account_id, lang FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS account_id FROM documents) d JOIN acc a ON a.id = d.account_id WHERE a.enabled AND a.id % 2 = 1 AND lang = 'es') HAVING count(*) > 0",
    "acc",
)
def _(s, d):
    """Accounts with even numbers are synced; no account has a folder es yet."""
    coded = F.translate(F.base64("eml"), "+/\r\n", "-_")
    batch = _messages(s, d).select("key", "account_id", "mailbox", coded.alias("coded"))
    accounts = X.accounts(s, d).withColumn("synced", F.col("id") % 2 == 0)
    folder = X.table(s, d, "documents").select(F.substring("source", 4, 9).cast("bigint").alias("account_id"), F.col("lang").alias("name")).where("name <> 'es'").distinct()
    rows, made = eml.imported(batch, accounts, folder)
    counted = rows.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))
    return counted.union(made.agg(F.count("*").alias("n")).select(F.lit("new folders"), "n").where("n > 0"))


def _landed(s, d):
    """Documents as a landing folder of pulled messages."""
    path = scratch(s, "landing")
    _messages(s, d).select("account_id", "mailbox", F.col("key").alias("uid"), (F.col("key") * 1000).alias("internal_date"), F.lit(None).cast("bigint").alias("size"), F.col("eml").alias("body"), F.col("key").alias("seq")).write.parquet(path)
    return path


@query("s03_pulled_batch", f"SELECT doc_id AS uid, {_H.format('account_id || ' + repr(':') + ' || md5(text) || ' + repr('@fixture'))} AS id, doc_id * 1000 AS internal_date, sha256(text) AS text_sha256 FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS account_id FROM documents) WHERE doc_id % 9 <> 0")
def _(s, d):
    good, _ = eml.split_errors(stream.pulled(stream.landed(s, _landed(s, d))))
    return good.select("uid", "id", "internal_date", F.sha2("text", 256).alias("text_sha256"))


@query("t01_t02_streamed_logs", f"SELECT {_H.format('account_id || ' + repr(':') + ' || md5(text) || ' + repr('@fixture'))} AS id, max(doc_id) AS uid FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS account_id FROM documents) WHERE doc_id % 9 <> 0 GROUP BY 1")
def _(s, d):
    root = scratch(s, "logs")
    stream.run(s, _landed(s, d), root).awaitTermination()
    return maintenance.current(stream.written(s, root, "envelopes")).select("id", "uid")


@query("t06_planned_rows", f"SELECT d.uid FROM (SELECT *, doc_id AS uid, CAST(substr(source, 4) AS BIGINT) AS account_id FROM documents) d JOIN acc ON acc.id = d.account_id LEFT JOIN (SELECT account_id, mailbox_id, max(uid) AS m FROM ea WHERE uid < 150 GROUP BY ALL) h ON h.account_id = d.account_id AND h.mailbox_id = {_H.format('d.account_id || ' + repr(':') + ' || d.lang')} WHERE enabled AND (acc.id % 3 = 0 OR acc.id % 5 <> 1 AND acc.id * 600000 > sync_interval_min * 60000 AND d.uid > coalesce(m, -1))", "ea", "acc")
def _(s, d):
    high = aggregates.max_uid(X.envelopes_all(s, d).where("uid < 150"))
    return stream.planned(stream.landed(s, _landed(s, d)), X.accounts(s, d), _state(s, d), high, NOW).select("uid")


@query("t07_error_state", "SELECT user_id AS account_id, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def _(s, d):
    """The state that a stream of error events leaves behind; its batch twin is i11."""
    path, out = scratch(s, "errors"), scratch(s, "error-state")
    e = X.table(s, d, "events").where("event_type = 'error'")
    e.select(F.col("user_id").alias("account_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.format_string("%012d", "event_id").alias("error")).repartition(4).write.parquet(path)
    events = s.readStream.schema("account_id bigint, at bigint, error string").option("maxFilesPerTrigger", 2).parquet(path)
    keep = lambda rows, k: rows.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/part={k}")
    stream.error_state(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch(s, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = maintenance.latest(s.read.parquet(out), "account_id", "batch")
    return last.select("account_id", F.explode("error").alias("error")).select("account_id", F.col("error").cast("bigint").alias("event_id"))


@query("r05_user_summaries", "SELECT id AS user_id, CASE WHEN id % 10 = 0 THEN 'admin' WHEN id % 3 = 0 THEN 'Unknown Role,member' END AS global_roles, 2 AS n_accounts FROM u", "u")
def _(s, d):
    rows = access.summaries(X.users(s, d), access.builtin_roles(s))
    return rows.select("user_id", F.array_join("global_roles", ",").alias("global_roles"), F.size("account_roles").alias("n_accounts"))


# ---------------------------------------------------------------- ingest planning


def _state(s, d):
    a = X.accounts(s, d)
    return a.where("id % 3 <> 0").select(F.col("id").alias("account_id"), F.when(F.col("id") % 5 == 1, F.lit(NOW - 30000)).alias("initial_end"), F.lit(None).cast("bigint").alias("initial_failed"), (F.lit(NOW) - F.col("id") * 600000).alias("last_start"))


@query("i01_run_action", f"SELECT id, CASE WHEN id % 3 = 0 THEN 'initial' WHEN id % 5 = 1 THEN 'skip' WHEN id * 600000 > sync_interval_min * 60000 THEN 'incremental' ELSE 'skip' END AS action FROM acc WHERE enabled", "acc")
def _(s, d):
    return ingest.run_action(X.accounts(s, d), _state(s, d), NOW)


@query("i02_folder_selection", "SELECT account_id, name FROM (SELECT *, bool_or(subscribed) OVER (PARTITION BY account_id) AS any_one FROM mr WHERE lower(flag) <> '\\noselect') WHERE CASE WHEN any_one THEN subscribed ELSE lower(name) = 'inbox' OR lower(flag) = '\\sent' END", "mr")
def _(s, d):
    return folders.selected(X.mailboxes_remote(s, d)).select("account_id", "name")


@query("i02_accounts_without_folder", "SELECT DISTINCT account_id FROM mr WHERE account_id NOT IN (SELECT account_id FROM (SELECT *, bool_or(subscribed) OVER (PARTITION BY account_id) AS any_one FROM mr WHERE lower(flag) <> '\\noselect') WHERE CASE WHEN any_one THEN subscribed ELSE lower(name) = 'inbox' OR lower(flag) = '\\sent' END)", "mr")
def _(s, d):
    return folders.without_folder(X.mailboxes_remote(s, d)).select("account_id")


@query("i03_reconcile_plan", "SELECT coalesce(mr.account_id, mb.account_id) AS account_id, coalesce(mr.name, mb.name) AS name, CASE WHEN mr.account_id IS NULL THEN 'keep' WHEN mb.account_id IS NULL AND mr.\"exists\" > 0 THEN 'load' WHEN mb.account_id IS NULL THEN 'create' WHEN mr.uid_validity IS NULL THEN 'skip' WHEN mr.uid_validity = mb.uid_validity THEN 'incremental' ELSE 'rebuild' END AS action FROM mr FULL JOIN mb ON mb.account_id = mr.account_id AND mb.name = mr.name", "mb", "mr")
def _(s, d):
    return folders.plan(X.mailboxes_remote(s, d), X.mailboxes(s, d))


@query("i04_incremental_cut", 'SELECT a.id, a.uid FROM ea a LEFT JOIN (SELECT account_id, mailbox_id, max(uid) AS m FROM ea WHERE uid < 150 GROUP BY ALL) h ON h.account_id = a.account_id AND h.mailbox_id = a.mailbox_id WHERE a.uid > coalesce(m, -1) AND a."date" < 1706000000000', "ea")
def _(s, d):
    e = X.envelopes_all(s, d)
    return ingest.after_high_water(e, aggregates.max_uid(e.where("uid < 150")), 1706000000000).select("id", "uid")


@query("i05_windows", "SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - INTERVAL 10 DAY AS DATE) AS ten_days, CAST(CAST(ts AS DATE) - INTERVAL 3 MONTH AS DATE) AS three_months, CAST(CAST(ts AS DATE) - INTERVAL 2 YEAR AS DATE) AS two_years FROM events")
def _(s, d):
    day = X.table(s, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return day.select("day", ingest.window_bound(F.col("day"), 10, "days").alias("ten_days"), ingest.window_bound(F.col("day"), 3, "months").alias("three_months"), ingest.window_bound(F.col("day"), 2, "years").alias("two_years"))


@query("i05_messages_in_windows", 'SELECT id, \'since\' AS window FROM e WHERE "date" >= epoch_ms(DATE \'2024-01-10\') UNION ALL SELECT id, \'before\' FROM e WHERE "date" < epoch_ms(DATE \'2024-01-11\')', "e")
def _(s, d):
    e, now = X.envelopes(s, d).select("id", "date"), datetime.date(2024, 1, 31)
    since = ingest.in_window(e, now, since={"fixed": "2024-01-10"}).select("id", F.lit("since").alias("window"))
    return since.union(ingest.in_window(e, now, before={"amount": 20, "unit": "days"}).select("id", F.lit("before")))


@query("i06_load_size", 'SELECT account_id, name, CASE WHEN 30 < "exists" THEN least("exists", 100) ELSE "exists" END AS n FROM mb', "mb")
def _(s, d):
    return X.mailboxes(s, d).select("account_id", "name", ingest.load_size(F.col("exists"), 30).cast("bigint").alias("n"))


_BATCHES = "b AS (SELECT account_id, mailbox_id, uid, (row_number() OVER (PARTITION BY account_id, mailbox_id ORDER BY uid DESC) - 1) // 6 AS batch FROM ea)"


@query("i07_uid_batches", f", {_BATCHES} SELECT * FROM b", "ea")
def _(s, d):
    return ingest.uid_batches(X.envelopes_all(s, d).select("account_id", "mailbox_id", "uid"), 6, descending=True)


@query("i08_uid_ranges", f", {_BATCHES} SELECT account_id, mailbox_id, batch, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || ':' || hi END, ',' ORDER BY lo) AS uids FROM (SELECT account_id, mailbox_id, batch, min(uid) AS lo, max(uid) AS hi FROM (SELECT *, uid - row_number() OVER (PARTITION BY account_id, mailbox_id, batch ORDER BY uid) AS island FROM b) GROUP BY account_id, mailbox_id, batch, island) GROUP BY ALL", "ea")
def _(s, d):
    return ingest.uid_ranges(ingest.uid_batches(X.envelopes_all(s, d).select("account_id", "mailbox_id", "uid"), 6, descending=True))


@query("i09_sequence_windows", 'SELECT account_id, name, page, greatest("exists" - page * 7 + 1, 1) AS low, "exists" - (page - 1) * 7 AS high FROM (SELECT *, unnest(generate_series(1, CAST(ceil("exists" / 7.0) AS BIGINT))) AS page FROM mb)', "mb")
def _(s, d):
    return ingest.sequence_windows(X.mailboxes(s, d), 7, from_end=True)


@query("i10_progress", "SELECT user_id AS account_id, event_type AS folder, max_by(event_id % 100 + 10, (ts, event_id % 100 + 10)) AS total, max(event_id % 90) AS current, max(event_id % 90) = max_by(event_id % 100 + 10, (ts, event_id % 100 + 10)) AS complete FROM events GROUP BY ALL")
def _(s, d):
    e = X.table(s, d, "events").select(F.col("user_id").alias("account_id"), F.col("event_type").alias("folder"), (F.col("event_id") % 100 + 10).alias("total"), (F.col("event_id") % 90).alias("current"), F.col("ts").alias("at"))
    return ingest.progress(e)


@query("i11_last_errors", "SELECT user_id AS account_id, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def _(s, d):
    e = X.table(s, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("error"), F.col("ts").alias("at"))
    return ingest.last_errors(e).select("account_id", F.col("error").alias("event_id"))


# ---------------------------------------------------------------- folder tree

_PATHS = "fp AS (SELECT account_id, 'Archive/' || mailbox_name || '/' || strftime(make_timestamp(\"date\" * 1000), '%Y-%m') AS name, count(*) AS messages FROM e GROUP BY ALL), n AS (SELECT account_id, messages, unnest(['Archive', regexp_extract(name, '^[^/]+/[^/]+'), name]) AS path FROM fp)"


def _paths(s, d):
    first = F.lit("1970-01-01").cast("date")
    month = F.date_format(F.date_add(first, F.floor(F.col("date") / C.DAY_MS).cast("int")), "yyyy-MM")
    return X.envelopes(s, d).groupBy("account_id", F.concat(F.lit("Archive/"), "mailbox_name", F.lit("/"), month).alias("name")).agg(F.count("*").alias("messages"))


@query("h01_folder_tree", f", {_PATHS} SELECT DISTINCT account_id, path, nullif(regexp_replace(path, '/?[^/]+$', ''), '') AS parent, regexp_extract(path, '[^/]+$') AS label, len(string_split(path, '/')) AS depth FROM n", "e")
def _(s, d):
    return folders.tree(_paths(s, d))


@query("h02_subtree_counts", f", {_PATHS} SELECT account_id, path, sum(messages)::BIGINT AS messages FROM n GROUP BY ALL", "e")
def _(s, d):
    return folders.subtree_counts(_paths(s, d))


# ---------------------------------------------------------------- state that follows writes, and layouts


def _halves(rows, column="seq"):
    """Rows up to the middle of a column, and those after it."""
    middle = rows.agg((F.min(column) + F.max(column)) / 2).first()[0]
    return rows.where(F.col(column) <= middle), rows.where(F.col(column) > middle)


_MIDDLE = "(SELECT (min(doc_id) + max(doc_id)) / 2 FROM documents)"
_BOX = _H.format("account_id || ':' || lang")


@query(
    "t06_stateful_plan",
    f"WITH d AS (SELECT doc_id AS uid, CAST(substr(source, 4) AS BIGINT) AS account_id, lang FROM documents), f AS (SELECT account_id, lang, {_BOX} AS k, max(uid) FILTER (uid <= {_MIDDLE}) AS high, count(*) AS n FROM d GROUP BY ALL), "
    "p AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'skip' WHEN k % 7 = 0 THEN 'rebuild' ELSE 'incremental' END AS action FROM f) "
    "SELECT account_id, lang AS mailbox, 'load' AS action, NULL::BIGINT AS uid FROM f UNION ALL SELECT account_id, lang, action, NULL FROM p "
    f"UNION ALL SELECT account_id, lang, 'fetch', uid FROM d WHERE uid <= {_MIDDLE} UNION ALL SELECT d.account_id, d.lang, 'fetch', d.uid FROM d JOIN p USING (account_id, lang) WHERE d.uid > {_MIDDLE} AND action <> 'skip'",
)
def _(s, d):
    """Two rounds: every folder in its first epoch, then one in seven in another one and one in eleven without any; each round lists and lands half of the messages."""
    source, listings, root = (scratch(s, name) for name in ("rounds", "listings", "plan"))
    folder = X.table(s, d, "documents").select(F.substring("source", 4, 9).cast("bigint").alias("account_id"), F.col("lang").alias("mailbox"), "doc_id")
    folder = folder.groupBy("account_id", "mailbox").agg(F.count("*").alias("exists"), (F.max("doc_id") * 0).alias("seq"))
    k = C.scoped_id(F.col("account_id"), F.col("mailbox"))
    landed = stream.landed(s, _landed(s, d))
    first, second = _halves(landed)
    between = first.agg(F.max("seq")).first()[0] or 0
    epochs = (F.lit(1).cast("bigint"), F.when(k % 11 == 0, None).when(k % 7 == 0, 2).otherwise(1).cast("bigint"))
    for epoch, rows, seq in zip(epochs, (first, second), (-1, between)):
        folder.select("account_id", "mailbox", epoch.alias("uid_validity"), "exists", F.lit(seq).cast("bigint").alias("seq")).coalesce(1).write.mode("append").parquet(listings)
        rows.write.mode("append").parquet(source)
        planner.run(s, source, listings, root, cool_down_ms=0).awaitTermination()
    return planner.decided(s, root).select("account_id", "mailbox", "action", "uid")


@query("t04_replayed_landing", f"SELECT {_H.format('account_id || ' + repr(':') + ' || md5(text) || ' + repr('@fixture'))} AS id, max(doc_id) AS uid, 1 AS n FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS account_id FROM documents) WHERE doc_id % 9 <> 0 GROUP BY 1")
def _(s, d):
    """Every file of the landing folder comes twice; n counts how often the message that stays was written."""
    source, root = _landed(s, d), scratch(s, "logs")
    stream.landed(s, source).write.mode("append").parquet(source)
    stream.run(s, source, root, replays="7 days").awaitTermination()
    log = stream.written(s, root, "envelopes")
    return log.join(maintenance.latest(log).select("id", "seq"), ["id", "seq"], "left_semi").groupBy("id", "uid").agg(F.count("*").cast("int").alias("n"))


@query("m02_snapshot_and_tail", f", {_ALIVE} SELECT id, account_id, uid FROM alive", "e")
def _(s, d):
    """The current view from a snapshot of the log's first half and the ops after it."""
    root, path, whole = scratch(s, "snapshots"), scratch(s, "log"), scratch(s, "whole-log")
    dated = _log(s, d).withColumn("date", F.lit(NOW) - F.col("uid") * 86400000 * 31)
    dated.write.option("compression", "zstd").parquet(whole)
    for batch, rows in enumerate(_halves(s.read.schema(dated.schema).parquet(whole))):
        rows.write.parquet(f"{path}/batch={batch}")
        if batch == 0:
            log = s.read.schema(StructType([*dated.schema]).add("batch", "long")).parquet(path)
            snapshots.compact(log, None, root)
    log = s.read.schema(StructType([*dated.schema]).add("batch", "long")).parquet(path)
    return snapshots.view(s, root, log).select("id", "account_id", "uid")


@query(
    "f15_index_after_writes",
    f"SELECT id, uid, \"date\" FROM e WHERE NOT has_attachment AND ((list_has_any({_TOK.format(_ALL)}, ['licensed', 'released']) AND NOT list_has_any({_TOK.format(_ALL)}, ['apache'])) OR (list_has_all({_TOK.format(_ALL)}, ['the', 'and']) AND contains(' ' || array_to_string({_TOK.format(_ALL)}, ' ') || ' ', ' all rights reserved ')))",
    "e",
)
def _(s, d):
    """Messages are indexed in two batches, the second with new versions of old ones; then those with attachments are deleted, and parts merged."""
    root, e = scratch(s, "living-index"), X.envelopes(s, d)
    for batch, rows in enumerate(_halves(X.envelopes_all(s, d))):
        living_index.add(s, root, batch, rows)
    gone = e.where("has_attachment")
    living_index.add(s, root, 2, X.envelopes_all(s, d).limit(0), gone.select("id", "seq"))
    living_index.merge(s, root)
    index, left = living_index.LivingIndex(s, root), e.where("not has_attachment")
    one = index.search(left, S.Search(any_words="licensed released", no_words="Apache"))
    two = index.search(left, S.Search(all_words="the and", phrase="All rights reserved"))
    return one.union(two).select(*_IDS).distinct()


@query(
    "a14_numbers_by_retraction",
    "WITH x AS (SELECT * FROM e WHERE NOT has_attachment) SELECT 'count' AS part, '' AS key, count(*) AS n FROM x UNION ALL SELECT 'size', '', sum(size)::BIGINT FROM x UNION ALL SELECT 'without_attachment', '', count(*) FROM x UNION ALL SELECT 'activity', CAST(\"date\" // 86400000 * 86400000 AS VARCHAR), count(*) FROM x GROUP BY ALL "
    "UNION ALL SELECT 'sender', \"from\", count(*) FROM x GROUP BY ALL UNION ALL SELECT 'account', CAST(account_id AS VARCHAR), count(*) FROM x GROUP BY ALL UNION ALL SELECT 'facet', path, count(DISTINCT id) FROM (SELECT id, unnest([regexp_extract(tag, '^/[^/]+'), tag]) AS path FROM (SELECT id, unnest(tags) AS tag FROM x)) GROUP BY ALL".replace("WITH x", ", x"),
    "e",
)
def _(s, d):
    """All versions come in two batches; then the messages with attachments are deleted."""
    source, root = scratch(s, "changes"), scratch(s, "numbers")
    columns = ["op", "seq", "id", "account_id", "mailbox_id", "from", "date", "size", "has_attachment", "tags"]
    upserts = X.envelopes_all(s, d).withColumn("op", F.lit("upsert")).select(columns)
    gone = X.envelopes(s, d).where("has_attachment").select("id", "seq", F.lit("delete").alias("op"))
    for rows in (*_halves(upserts), upserts.limit(0).unionByName(gone, allowMissingColumns=True)):
        rows.write.mode("append").parquet(source)
        deltas.run(s, source, root).awaitTermination()
    return deltas.numbers(s, root)


@query("l01_deep_page", 'SELECT id, uid, "date" FROM e ORDER BY "date" DESC, id LIMIT 20 OFFSET (SELECT count(*) // 40 * 20 FROM e)', "e")
def _(s, d):
    """The page in the middle, from the ranges that hold it."""
    path, e = scratch(s, "ranges"), X.envelopes(s, d).select(*_IDS)
    layouts.write_ranges(e, path, 100)
    return layouts.page_of_ranges(s, path, e.schema, e.count() // 40 + 1, 20)


@query("j03_bucketed_envelope_and_raw", "SELECT id, uid, length(text) AS n_chars FROM e", "e")
def _(s, d):
    """Both tables bucketed by id, so that the join moves neither."""
    raw = _raw(s, d).select("id", "eml")
    n = layouts.buckets_for(raw, 1 << 20)
    e, r = (layouts.write_bucketed(rows, scratch(s, "bucketed"), n) for rows in (X.envelopes(s, d).select("id", "uid"), raw))
    return layouts.with_raw(e, r).select("id", "uid", F.length(F.decode("eml", "UTF-8")).cast("bigint").alias("n_chars"))


@query("r03_pruned_scope", "SELECT e.id, account_id, uid FROM e, u WHERE u.id = 7 AND account_id IN (a1, a2)", "e", "u")
def _(s, d):
    """A table by account, of which the folders in scope are opened."""
    path, e = scratch(s, "by-account"), X.envelopes(s, d).select("id", "account_id", "uid")
    layouts.write_by_account(e, path)
    scope = access.read_scope(X.users(s, d), access.builtin_roles(s))
    return access.scoped(layouts.read_by_account(s, path, e.schema), scope, 7).select("id", "account_id", "uid")


@query("s06_eml_files", "SELECT id, sha256(text) AS eml_sha256 FROM e", "e")
def _(s, d):
    """Every message as a file of its own, read again as files."""
    path = scratch(s, "eml-files")
    mail_files.export(_raw(s, d), path)
    return s.read.format("mail").option("layout", "ids").load(path).select("id", F.sha2("eml", 256).alias("eml_sha256"))


entry = search_page
