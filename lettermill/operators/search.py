"""Filters, sorting and paging over envelopes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MEDIUM, SMALL, TINY, has_tag, preview, tokens

MAX_PAGE_SIZE = 500
# Size presets as inclusive bounds.
SIZE_PRESETS = {"tiny": (None, TINY), "small": (None, SMALL), "medium": (None, MEDIUM), "large": (MEDIUM, None)}


@dataclass
class Search:
    """Criteria that must all hold; blank ones are dropped. An empty search finds everything.

    has_attachment filters only when true. accounts is the scope: None for all, an empty list for nothing.
    """

    all_words: str | None = None
    any_words: str | None = None
    no_words: str | None = None
    phrase: str | None = None
    tags: list[str] | None = None
    sender: str | None = None
    to: str | None = None
    cc: str | None = None
    bcc: str | None = None
    has_attachment: bool | None = None
    attachment_name: str | None = None
    since: int | None = None
    before: int | None = None
    account_id: int | None = None
    mailbox_id: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    size_preset: str | None = None
    message_id: str | None = None

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if value is None or isinstance(value, (str, list)) and not (value.strip() if isinstance(value, str) else value):
                setattr(self, f.name, None)
        if self.size_preset and self.size_preset not in SIZE_PRESETS:
            raise ValueError(f"unknown size preset {self.size_preset}")


def searched_text() -> Column:
    """What full-text search looks at."""
    return F.concat_ws("\n", "subject", "text", F.array_join("attachments", "\n"))


def _words(text: str) -> Column:
    return tokens(F.lit(text))


def full_text(all_words: str | None = None, any_words: str | None = None, no_words: str | None = None, phrase: str | None = None) -> Column:
    """Scan plan of full-text search, on token arrays."""
    own, found = tokens(searched_text()), F.lit(True)
    if all_words:
        found = found & (F.size(F.array_except(_words(all_words), own)) == 0)
    if any_words:
        found = found & F.arrays_overlap(own, _words(any_words))
    if no_words:
        found = found & ~F.arrays_overlap(own, _words(no_words))
    if phrase:
        # Tokens hold no blanks, so a phrase of tokens is a substring of the joined ones.
        joined = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
        found = found & F.contains(joined, F.concat(F.lit(" "), F.array_join(_words(phrase), " "), F.lit(" ")))
    return found


def attachment_named(name: str) -> Column:
    return F.exists("attachments", lambda a: F.array_contains(tokens(a), name.lower()))


def in_scope(accounts: list[int] | None, column: str = "account_id") -> Column:
    """None: everything; a list: any of it; an empty list: nothing."""
    if accounts is None:
        return F.lit(True)
    return F.col(column).isin(accounts) if accounts else F.lit(False)


def condition(search: Search, accounts: list[int] | None = None) -> Column:
    """One conjunction; plain comparisons come first so that they reach the scan."""
    s, found = search, in_scope(accounts)
    low, high = SIZE_PRESETS.get(s.size_preset, (None, None))
    equal = {"account_id": s.account_id, "mailbox_id": s.mailbox_id, "from": s.sender, "message_id": s.message_id}
    for column, value in equal.items():
        if value is not None:
            found = found & (F.col(column) == value)
    for column, value in (("date", s.since), ("size", s.min_size), ("size", low)):
        if value is not None:
            found = found & (F.col(column) >= value)
    for column, value in (("date", s.before), ("size", s.max_size), ("size", high)):
        if value is not None:
            found = found & (F.col(column) <= value)
    if s.has_attachment:
        found = found & F.col("has_attachment")
    for column, value in (("to", s.to), ("cc", s.cc), ("bcc", s.bcc)):
        if value is not None:
            found = found & F.array_contains(column, value)
    if s.tags:
        found = found & has_tag(F.col("tags"), s.tags)
    if s.attachment_name:
        found = found & attachment_named(s.attachment_name)
    return found & full_text(s.all_words, s.any_words, s.no_words, s.phrase)


def search(envelopes: DataFrame, criteria: Search, accounts: list[int] | None = None) -> DataFrame:
    return envelopes.where(condition(criteria, accounts))


def page(found: DataFrame, number: int | None = None, size: int | None = None, descending: bool = True, by: str = "date", key: str = "id", limit_size: bool = True) -> DataFrame:
    """One page in the order of by, then key; without number and size, everything."""
    order = [F.col(by).desc() if descending else F.col(by).asc(), F.col(key).asc()]
    if number is None or size is None:
        return found.orderBy(*order)
    if number < 1 or size < 1 or limit_size and size > MAX_PAGE_SIZE:
        raise ValueError(f"page must be at least 1 and size from 1 to {MAX_PAGE_SIZE}")
    return found.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(found: DataFrame, last_date: int | None, last_id: int | None, size: int) -> DataFrame:
    """The next page by key, which costs the same at any depth."""
    if last_date is not None:
        found = found.where((F.col("date") < last_date) | (F.col("date") == last_date) & (F.col("id") > last_id))
    return found.orderBy(F.col("date").desc(), "id").limit(size)


def totals(found: DataFrame, size: int) -> DataFrame:
    """total_items and total_pages."""
    return found.agg(F.count("*").alias("total_items")).withColumn("total_pages", F.ceil(F.col("total_items") / size).cast("bigint"))


def with_names(found: DataFrame, accounts: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Adds account_email and mailbox_name, null where unknown; meant for rows after the page is cut."""
    a = accounts.select(F.col("id").alias("account_id"), F.col("email").alias("account_email"))
    m = mailboxes.select("account_id", F.col("id").alias("mailbox_id"), F.col("name").alias("mailbox_name"))
    return found.drop("mailbox_name").join(a, "account_id", "left").join(m, ["account_id", "mailbox_id"], "left")


def result_page(envelopes: DataFrame, criteria: Search, number: int, size: int, accounts: DataFrame, mailboxes: DataFrame, scope: list[int] | None = None, descending: bool = True) -> DataFrame:
    """The search request: filter, sort and cut, then names and previews for the rows that are left."""
    cut = page(search(envelopes, criteria, scope), number, size, descending)
    return with_names(cut.withColumn("preview", preview(F.col("text"))).drop("text"), accounts, mailboxes)
