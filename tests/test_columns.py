import pytest
from pyspark.sql import functions as F

from lettermill.functions import columns as C

SUBJECTS = [
    ("=?utf-8?B?w6k=?=\r\n =?utf-8?b?w6o=?= folded", "=?utf-8?B?w6k=w6o=?= folded"),
    # A character cut in two: only the joined word decodes.
    ("Re: =?UTF-8?Q?caf=C3?= =?UTF-8?Q?=A9?=", "Re: =?UTF-8?Q?caf=C3=A9?="),
    ("=?KOI8-R?B?8A==?= =?ISO-8859-1?Q?=E9?= =?UTF-8?B?w6k=?=", "=?KOI8-R?B?8A==?= =?ISO-8859-1?Q?=E9?= =?UTF-8?B?w6k=?="),
    ("=?big5?Q?a?= =?big5?B?YQ==?=", "=?big5?Q?a?= =?big5?B?YQ==?="),
    ("one =?UTF-8?Q?two?= three =?UTF-8?Q?four?=\t=?UTF-8?Q?five?= six", "one =?UTF-8?Q?two?= three =?UTF-8?Q?fourfive?= six"),
    ("no word at all, only =? marks ?=", "no word at all, only =? marks ?="),
    ("", ""),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_subjects(spark):
    rows = spark.createDataFrame(SUBJECTS, "subject string, wanted string").select(C.repaired_subject(F.col("subject")).alias("got"), "wanted").collect()
    assert all(r["got"] == r["wanted"] for r in rows)


def test_tokens(spark):
    assert one(spark, C.tokens(F.lit("Été-2024 x_y " + "z" * 41))) == ["été", "2024", "x", "y"]
    assert one(spark, C.tokens(F.lit(None).cast("string"))) == []


def test_thread_needs_both_headers(spark):
    refs, none = F.array(F.lit("root"), F.lit("b")), F.array().cast("array<string>")
    root, own = one(spark, C.hash53(F.lit("root"))), one(spark, C.hash53(F.lit("m")))
    assert one(spark, C.thread_id(F.lit("b"), refs, F.lit("m"))) == root
    assert one(spark, C.thread_id(F.lit(None).cast("string"), refs, F.lit("m"))) == own
    assert one(spark, C.thread_id(F.lit("b"), none, F.lit("m"))) == own


def test_tags(spark):
    assert one(spark, C.clean_tags(F.array(F.lit(" /A "), F.lit("/a")))) == ["/a"]
    assert [one(spark, C.tag_problem(F.lit(t))) for t in ("", "a", "/a\\", "/a\\\\", "/a")] == ["empty", "no leading slash", "dangling escape", None, None]


def test_flags(spark):
    got = [tuple(one(spark, C.folder_flag(F.lit(f)))) for f in ("\\Sent", "\\X", "")]
    assert got == [("Sent", None), ("Extension", "\\X"), ("Unknown", None)]


@pytest.mark.parametrize("x,good", [("a@b.org", True), ("a@b", False), ("A <a@b.org>", False), ("a..b@c.org", False), (None, False)])
def test_email(spark, x, good):
    assert one(spark, C.is_email(F.lit(x).cast("string"))) is good
