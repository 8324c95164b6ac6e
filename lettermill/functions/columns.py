"""Column functions of the mail archive; each is a Spark expression, so filters and codegen see through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the size presets, in bytes.
TINY, SMALL, MEDIUM = 15 * 1024, 2 * 1024 * 1024, 20 * 1024 * 1024
# The folder flags that are known by name.
FOLDER_FLAGS = ["NoInferiors", "NoSelect", "Marked", "Unmarked", "All", "Archive", "Drafts", "Flagged", "Junk", "Sent", "Trash"]
DAY_MS = 86_400_000
MAX_TOKEN_BYTES = 40


def hash53(x: Column) -> Column:
    """A stable id below 2 ** 53 from a string."""
    return F.conv(F.substring(F.md5(x), 1, 13), 16, 10).cast("bigint")


def scoped_id(account: Column, name: Column) -> Column:
    """The id of something named within an account."""
    return hash53(F.concat(account.cast("string"), F.lit(":"), name))


def thread_id(in_reply_to: Column, references: Column, message_id: Column) -> Column:
    """The thread of the first reference if the message answers one, else the message's own."""
    return hash53(F.when(in_reply_to.isNotNull() & (F.size(references) > 0), F.get(references, F.lit(0))).otherwise(message_id))


def default_message_id(message_id: Column, raw: Column) -> Column:
    """The message id, or one from the bytes, so that the same message always gets the same."""
    return F.coalesce(message_id, F.concat(F.lit("<"), F.sha2(raw, 256), F.lit("@generated>")))


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits of at most 40 bytes."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    return F.filter(found, lambda t: F.octet_length(t) <= MAX_TOKEN_BYTES)


def preview(text: Column, size: int = 120) -> Column:
    """The first characters, with three dots if more follow."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def body_text(plain: Column, html: Column) -> Column:
    return F.coalesce(plain, html_text(html), F.lit(""))


def html_text(html: Column) -> Column:
    """Text of a page by expressions alone: no scripts or styles, blocks on lines of their own, common references decoded."""
    x = F.regexp_replace(html, "(?is)<(script|style|head)\\b.*?</\\1>|<!--.*?-->", "")
    x = F.regexp_replace(x, "(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|footer|header)\\b[^>]*>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(mark))
    x = F.regexp_replace(x, "[ \\t]+", " ")
    return F.btrim(F.regexp_replace(x, " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, rounded down; 0 for none."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.coalesce(F.floor(micros / 1000).cast("bigint"), F.lit(0).cast("bigint"))


def size_bucket(size: Column) -> Column:
    return F.when(size <= TINY, "tiny").when(size <= SMALL, "small").when(size < MEDIUM, "medium").otherwise("large")


_WORD = r"=\?([^?]+)\?([bBqQ])\?([^?]+)\?="
_WORDS = r"=\?[^?]+\?[bBqQ]\?[^?]+\?=(?:\s+=\?[^?]+\?[bBqQ]\?[^?]+\?=)+"


def repaired_subject(subject: Column) -> Column:
    """A run of encoded words of one charset and encoding becomes one word, so that a character cut in two decodes; a mixed run stays."""

    def joined(run: Column) -> Column:
        part = lambda k: F.regexp_extract_all(run, F.lit(_WORD), F.lit(k))
        charset, encoding = F.array_distinct(part(1)), F.array_distinct(F.transform(part(2), F.upper))
        one = F.concat(F.lit("=?"), F.get(charset, F.lit(0)), F.lit("?"), F.get(encoding, F.lit(0)), F.lit("?"), F.array_join(part(3), ""), F.lit("?="))
        return F.when((F.size(charset) == 1) & (F.size(encoding) == 1), one).otherwise(run)

    return F.aggregate(F.regexp_extract_all(subject, F.lit(_WORDS), F.lit(0)), subject, lambda s, run: F.replace(s, run, joined(run)))


def embedded_images(html: Column, inline: Column) -> Column:
    """cid: links become data URIs. inline: array of (content_id, mime, data)."""
    return F.aggregate(inline, html, lambda h, a: F.replace(h, F.concat(F.lit("cid:"), a["content_id"]), F.concat(F.lit("data:"), a["mime"], F.lit(";base64,"), F.base64(a["data"]))))


def folder_flag(flag: Column) -> Column:
    """(attr, extension) of a folder flag as a server writes it: known flags by name, any other one as an extension with its text."""
    known = F.create_map(*[F.lit(x) for name in FOLDER_FLAGS for x in ("\\" + name.lower(), name)])
    name = F.try_element_at(known, F.lower(flag))
    return F.struct(
        F.coalesce(name, F.when(F.length(flag) > 0, "Extension"), F.lit("Unknown")).alias("attr"),
        F.when(name.isNull() & (F.length(flag) > 0), flag).alias("extension"),
    )


def is_email(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+$") & ~x.contains("..") & ~x.startswith("."), F.lit(False))


def clean_tags(tags: Column) -> Column:
    """Lower-cased, trimmed and distinct tags."""
    return F.array_distinct(F.transform(tags, lambda t: F.lower(F.trim(t))))


def tag_problem(tag: Column) -> Column:
    """What is wrong with a normalised tag, or null."""
    return F.when(tag == "", "empty").when(~tag.startswith("/"), "no leading slash").when(F.length(F.regexp_extract(tag, "(\\\\*)$", 1)) % 2 == 1, "dangling escape")


def has_tag(tags: Column, wanted: list[str]) -> Column:
    """Any of the wanted tags, or one below it."""
    def one(w: str) -> Column:
        return F.exists(tags, lambda t: (t == w) | t.startswith(w + "/"))

    found = F.lit(False)
    for w in wanted:
        found = found | one(w)
    return found


def path_prefixes(path: Column, delimiter: str = "/") -> Column:
    """All ancestors of a path, and the path."""
    parts = F.split(path, f"\\Q{delimiter}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), delimiter))
