"""Raw messages to envelopes and attachments: one pass with the standard library's parser over the raw column.

A message that can't be parsed becomes a row with an error and never fails a task. The batch source takes URL-safe base64 in
a column; files come by spark.read.format("binaryFile").
"""

from __future__ import annotations

import email
import email.policy
import re
from base64 import b64encode
from collections.abc import Iterator
from datetime import UTC
from email.header import decode_header, make_header
from email.utils import getaddresses, parsedate_to_datetime
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

from ..functions.columns import default_message_id, scoped_id, thread_id
from ..operators.maintenance import restore_status
from ..schemas import ATTACHMENTS
from .html_text import html_to_text

PARSED = "error string, message_id string, in_reply_to string, `references` array<string>, subject string, `from` string, `to` array<string>, cc array<string>, bcc array<string>, date bigint, plain string, html string, body string, attachments array<string>"
_LISTS = ("references", "to", "cc", "bcc", "attachments")
_NAMES = ("error", "message_id", "in_reply_to", "references", "subject", "from", "to", "cc", "bcc", "date", "plain", "html", "body", "attachments")
_ARROW = pa.schema([(n, pa.list_(pa.string()) if n in _LISTS else pa.int64() if n == "date" else pa.string()) for n in _NAMES])
#: Messages that a restore takes at most.
MOST_RESTORED = 100

@pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_to_text)


@pandas_udf(StringType())
def folder_name(names: pd.Series) -> pd.Series:
    """Folder names from modified UTF-7."""

    def one(name):
        if name is None:
            return None
        part = lambda m: "&" if not m[1] else ("+" + m[1].replace(",", "/") + "-").encode().decode("utf-7")
        try:
            return re.sub(r"&([^-]*)-", part, name)
        except UnicodeError:
            return name

    return names.map(one)


@pandas_udf(StringType())
def encoded_folder_name(names: pd.Series) -> pd.Series:
    """Folder names in modified UTF-7."""

    def one(name):
        if name is None:
            return None
        far = lambda m: "&" + m[0].encode("utf-16-be").hex() + "-"
        import base64

        return re.sub(r"[^\x20-\x7e]+", lambda m: "&" + base64.b64encode(bytes.fromhex(far(m)[1:-1])).decode().rstrip("=").replace("/", ",") + "-", name.replace("&", "&-"))

    return names.map(one)


def _addresses(message, name: str) -> list[str]:
    return [a for _, a in getaddresses([str(v) for v in message.get_all(name, [])]) if "@" in a]


def _subject(message) -> str:
    value = message.get("Subject")
    try:
        return str(make_header(decode_header(str(value)))) if value is not None else ""
    except (LookupError, UnicodeError, ValueError):
        return str(value)


def _text(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _ms(time) -> int:
    """Milliseconds since 1970; a zone of -0000 says nothing of where a sender is, but its time is that of UTC."""
    return int((time if time.tzinfo else time.replace(tzinfo=UTC)).timestamp()) * 1000


def _file_name(part, key: int, offset: int) -> str:
    return part.get_filename() or f"email{key}_attachment{offset}"


def _parts(message) -> Iterator:
    """The parts of a message that hold something, in order; what is attached as a message is one part, whatever is in it."""
    wait = [message]
    while wait:
        part = wait.pop()
        if part.is_multipart() and part.get_content_maintype() != "message":
            wait += reversed(part.get_payload())
        else:
            yield part


def _is_attachment(part) -> bool:
    return part.get_filename() is not None or part.get_content_disposition() == "attachment" or part.get_content_maintype() not in ("text", "multipart")


def _data(part) -> bytes:
    """The bytes of a part; of an attached message, that message."""
    if part.is_multipart():
        return b"".join(p.as_bytes() for p in part.get_payload())
    return part.get_payload(decode=True) or b""


def parsed_row(raw: bytes | None) -> dict:
    """One message; error tells why there is nothing else."""
    row = {n: [] if n in _LISTS else None for n in _NAMES}
    if not raw:
        return row | {"error": "missing body"}
    try:
        message = email.message_from_bytes(raw, policy=email.policy.compat32)
        if not message.keys():
            return row | {"error": "no headers"}
        date = message.get("Date")
        try:
            row["date"] = _ms(parsedate_to_datetime(str(date))) if date else 0
        except (ValueError, TypeError, OverflowError):
            row["date"] = 0
        for name, column in (("Message-ID", "message_id"), ("In-Reply-To", "in_reply_to")):
            value = message.get(name)
            row[column] = str(value).strip().strip("<>") or None if value is not None else None
        row["references"] = re.findall(r"<([^<>\s]+)>", str(message.get("References", "")))
        sender = _addresses(message, "From")
        row |= {"subject": _subject(message), "from": sender[0] if sender else "unknown", "to": _addresses(message, "To"), "cc": _addresses(message, "Cc"), "bcc": _addresses(message, "Bcc")}
        parts = list(_parts(message))
        bodies = [p for p in parts if not _is_attachment(p)]
        row["plain"] = next((_text(p) for p in bodies if p.get_content_type() == "text/plain"), None)
        row["html"] = next((_text(p) for p in bodies if p.get_content_type() == "text/html"), None)
        # Rendered here, where a message has no plain text, so that no body goes to Python twice.
        row["body"] = row["plain"] if row["plain"] is not None else html_to_text(row["html"]) or ""
        row["attachments"] = [p.get_filename() for p in parts if _is_attachment(p) and p.get_filename()]
        _writable(row)
    except Exception as e:  # one bad message is a quarantine row, whatever is wrong with it
        return {n: [] if n in _LISTS else None for n in _NAMES} | {"error": f"{type(e).__name__}: {e}"}
    return row


def _writable(row: dict) -> None:
    """Puts marks in the place of bytes that no charset explains, so that every text can be written as UTF-8."""
    clean = lambda x: x.encode("utf-8", "replace").decode() if isinstance(x, str) else x
    for n, x in row.items():
        row[n] = [clean(y) for y in x] if isinstance(x, list) else clean(x)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.RecordBatch.from_pylist([parsed_row(b) for b in batch.column("eml").to_pylist()], schema=_ARROW)
        yield pa.RecordBatch.from_arrays([*batch.columns, *rows.columns], names=[*batch.schema.names, *rows.schema.names])


def parse(messages: DataFrame) -> DataFrame:
    """messages, with a column eml, and their parsed headers and bodies; all columns that parsing doesn't make come along."""
    own = messages.drop(*_NAMES)
    return own.mapInArrow(_parsed, StructType(own.schema.fields + StructType.fromDDL(PARSED).fields))


def envelopes(messages: DataFrame, imported: bool = True) -> DataFrame:
    """Envelope rows, and error where there is none, for messages (key, account_id, mailbox, eml; pulled ones also uid, internal_date, size).

    refused, where messages has it, is the error of a row that is not to be parsed; seq comes along.
    """
    eml_size = F.octet_length("eml").cast("bigint")
    rows = parse(messages)
    message_id = default_message_id(F.col("message_id"), F.col("eml"))
    error = F.coalesce("refused", "error").alias("error") if "refused" in messages.columns else F.col("error")
    return rows.select(
        "key",
        error,
        scoped_id(F.col("account_id"), message_id).alias("id"),
        "account_id",
        scoped_id(F.col("account_id"), F.col("mailbox")).alias("mailbox_id"),
        (F.lit(0).cast("bigint") if imported else F.col("uid")).alias("uid"),
        "subject",
        F.coalesce("body", F.lit("")).alias("text"),
        "from",
        "to",
        "cc",
        "bcc",
        "date",
        (F.col("date") if imported else F.col("internal_date")).alias("internal_date"),
        (eml_size if imported else F.coalesce("size", eml_size)).alias("size"),
        thread_id(F.col("in_reply_to"), F.col("references"), message_id).alias("thread_id"),
        message_id.alias("message_id"),
        "attachments",
        (F.size("attachments") > 0).alias("has_attachment"),
        F.array().cast("array<string>").alias("tags"),
        "eml",
        *[c for c in ("seq",) if c in messages.columns],
    )


def imported(batch: DataFrame, accounts: DataFrame, mailboxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelope rows of a batch (key, account_id, mailbox, coded: URL-safe base64), and the folders (account_id, id, name, delimiter) that it makes.

    accounts: id, enabled, synced. Messages of unknown and disabled accounts are refused, and so are those for a folder that a
    synced account does not have; other accounts get their folder. Refused and broken messages have an error.
    """
    a = accounts.select(F.col("id").alias("account_id"), "enabled", "synced")
    known = mailboxes.select("account_id", F.col("name").alias("mailbox"), F.lit(True).alias("known")).distinct()
    rows = batch.join(a, "account_id", "left").join(known, ["account_id", "mailbox"], "left")
    refused = F.when(F.col("enabled").isNull(), "unknown account").when(~F.col("enabled"), "disabled account").when(F.col("synced") & F.col("known").isNull(), "unknown folder")
    broken = F.when(F.col("coded").isNotNull() & F.col("eml").isNull(), "invalid base64")
    taken = rows.withColumn("eml", from_base64(F.col("coded"))).withColumn("refused", F.coalesce(refused, broken))
    made = rows.where(refused.isNull() & F.col("known").isNull()).select("account_id", scoped_id(F.col("account_id"), F.col("mailbox")).alias("id"), F.col("mailbox").alias("name"), F.lit("/").alias("delimiter")).distinct()
    return envelopes(taken.select("key", "account_id", "mailbox", "eml", "refused")), made


def from_base64(column: Column) -> Column:
    """Bytes of URL-safe base64; null where it is not valid."""
    return F.try_to_binary(F.translate(column, "-_", "+/"), F.lit("base64"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the quarantine (index, error_message)."""
    return rows.where("error is null").drop("error"), rows.where("error is not null").select(F.col("key").alias("index"), F.col("error").alias("error_message"))


def batch_report(rows: DataFrame) -> DataFrame:
    """total = success + failed."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def _attachment_rows(message, key: int) -> Iterator[tuple]:
    """A row for each attachment, as ATTACHMENTS names them; one without a content type has an error and no bytes."""
    for k, p in enumerate(p for p in _parts(message) if _is_attachment(p)):
        cid, inline = p.get("Content-ID"), p.get_content_disposition() == "inline"
        cid = str(cid).strip().strip("<>") if cid else None
        if p.get("Content-Type") is None:
            yield key, k, _file_name(p, key, k), None, inline, cid, None, None, f"attachment {k} has no content type"
        else:
            data = _data(p)
            yield key, k, _file_name(p, key, k), p.get_content_type(), inline, cid, len(data), data, None


def _attachments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for key, raw in ((k, r) for b in batches for k, r in zip(b.column("id").to_pylist(), b.column("eml").to_pylist())):
        try:
            rows = list(_attachment_rows(email.message_from_bytes(raw or b""), key))
        except Exception:  # such a message is in the quarantine of the envelopes already
            continue
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def attachments(raw: DataFrame) -> DataFrame:
    """One row for each attachment of raw messages (id, eml); error where it can't be read."""
    schema = raw.sparkSession.createDataFrame([], ATTACHMENTS).toArrow().schema
    return raw.select("id", "eml").mapInArrow(partial(_attachments, schema=schema), ATTACHMENTS)


def attachment(raw: DataFrame, account_id: int, message: int, name: str) -> DataFrame:
    """The first attachment of that name; no row if there is none."""
    found = attachments(raw.where((F.col("account_id") == account_id) & (F.col("id") == message)))
    return found.where(F.col("filename") == name).orderBy("ordinal").limit(1)


CONTENT = "id bigint, text string, html string, attachments array<struct<ordinal:int,filename:string,mime:string,inline:boolean,size:bigint>>, error string"


def _contents(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for key, raw in ((k, r) for b in batches for k, r in zip(b.column("id").to_pylist(), b.column("eml").to_pylist())):
        row = parsed_row(raw)
        page, parts, error = row["html"], [], row["error"]
        if not error:
            for _, k, name, mime, inline, cid, size, data, why in _attachment_rows(email.message_from_bytes(raw), key):
                error = error or why
                parts.append({"ordinal": k, "filename": name, "mime": mime, "inline": inline, "size": size})
                if inline and cid and page and data is not None and cid in page:
                    page = page.replace(f"cid:{cid}", f"data:{mime};base64,{b64encode(data).decode()}")
        known = (key, None, None, None, error) if error else (key, row["plain"], page, parts, None)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(known, schema)], schema=schema)


def content(raw: DataFrame) -> DataFrame:
    """Text, HTML with its inline images put in, and attachments of raw messages (id, eml), in one pass; error tells why there is nothing.

    An image is put in where its part is inline by disposition and the page names it.
    """
    schema = raw.sparkSession.createDataFrame([], CONTENT).toArrow().schema
    return raw.select("id", "eml").mapInArrow(partial(_contents, schema=schema), CONTENT)


def export(raw: DataFrame, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Writes raw bytes by id, of all messages or of the ids (column id), for a bulk download; returns what was written."""
    chosen = raw if ids is None else raw.join(ids.select("id").distinct(), "id", "left_semi")
    chosen.select("id", "eml").write.option("compression", "zstd").parquet(path)
    return raw.sparkSession.read.schema("id bigint, eml binary").parquet(path)


def restored(ids: DataFrame, envelopes: DataFrame, raw: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Folder, status and bytes of at most MOST_RESTORED asked messages; bytes only where the status is ok."""
    n = ids.count()
    if n > MOST_RESTORED:
        raise ValueError(f"{n} messages to restore; at most {MOST_RESTORED} are taken at a time")
    found = restore_status(ids, envelopes, raw, mailboxes).join(raw.select("id", "eml"), "id", "left")
    return found.withColumn("eml", F.when(F.col("status") == "ok", F.col("eml")))


def stored_bytes(spark, path: str, scoped: bool = False) -> DataFrame:
    """Bytes of all files below a path, none for a caller who sees some accounts only; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lit(not scoped))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
