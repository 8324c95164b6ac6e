import pytest
from pyspark.sql import functions as F

from lettermill.sources import mail_files


@pytest.fixture(scope="module")
def source(spark):
    mail_files.register(spark)
    return spark


def put(root, messages):
    for account, mailbox, uid, body in messages:
        folder = root / str(account) / mail_files.quote(mailbox, safe="")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{uid}.eml").write_bytes(body)


MESSAGES = [(a, box, uid, b"Subject: x\r\n\r\n" + b"%d" % uid * 50) for a in (1, 2) for box in ("INBOX", "Sent/2024 é") for uid in range(1, 8)]


def test_folders_are_read_by_size_and_pruned(source, tmp_path):
    put(tmp_path, MESSAGES)
    (tmp_path / "1" / "INBOX" / "note.txt").write_text("no message")
    rows = source.read.format("mail").option("part_bytes", 200).load(str(tmp_path))
    assert sorted((r["account_id"], r["mailbox"], r["uid"], bytes(r["body"]), r["size"]) for r in rows.collect()) == sorted((*m, len(m[3])) for m in MESSAGES)
    assert rows.rdd.getNumPartitions() > 4 and source.read.format("mail").load(str(tmp_path)).rdd.getNumPartitions() == 4
    one = rows.where("account_id = 2 and mailbox in ('INBOX', 'none') and uid > 3")
    assert sorted(r["uid"] for r in one.collect()) == [4, 5, 6, 7]
    reader = mail_files.MailReader(str(tmp_path), "folders", 1 << 20, rows.schema)
    left = list(reader.pushFilters([mail_files.EqualTo(("account_id",), 2), mail_files.In(("mailbox",), ("INBOX",)), mail_files.EqualTo(("uid",), 3)]))
    assert [f.attribute for f in left] == [("uid",)] and list(reader.folders()) == ["2/INBOX"]
    assert source.read.format("mail").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="layout"):
        source.read.format("mail").option("layout", "x").load(str(tmp_path)).count()


def test_stream_goes_on_from_its_offsets(source, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    put(root, MESSAGES[:10])
    for more in (MESSAGES[10:], [(3, "New", 1, b"Subject: n\r\n\r\n")], []):
        stream = source.readStream.format("mail").load(str(root)).select("account_id", "mailbox", "uid", F.md5("body").alias("body"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start().awaitTermination()
        put(root, more)
    stream = source.readStream.format("mail").load(str(root)).select("account_id", "mailbox", "uid", F.md5("body").alias("body"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start().awaitTermination()
    got = [(r["account_id"], r["mailbox"], r["uid"]) for r in source.read.parquet(out).collect()]
    assert sorted(got) == sorted([m[:3] for m in MESSAGES] + [(3, "New", 1)])


def test_export_gives_equal_bytes(source, tmp_path):
    raw = source.createDataFrame([(k, 1, bytearray(b"\x00\xff%d" % k * k)) for k in range(40)] + [(7, 1, bytearray(b"\x00\xff7" * 7))], "id bigint, account_id bigint, eml binary")
    path = str(tmp_path / "export")
    some = source.createDataFrame([(3,), (9,), (9,), (77,)], "id bigint")
    for ids, want in ((None, range(40)), (some, (3, 9))):  # the second takes the place of the first
        mail_files.export(raw, path, ids)
        again = source.read.format("mail").option("layout", "ids").load(path)
        assert {r["id"]: bytes(r["eml"]) for r in again.collect()} == {k: b"\x00\xff%d" % k * k for k in want} and again.count() == len(want)
    assert sorted(p.name for p in (tmp_path / "export").rglob("*.eml")) == ["3.eml", "9.eml"]


def test_a_failed_export_leaves_nothing(source, tmp_path):
    path = tmp_path / "export"
    bad = source.range(10).repartition(3).select("id", F.when(F.col("id") < 9, F.encode(F.lit("x"), "UTF-8")).otherwise(F.raise_error(F.lit("stop"))).cast("binary").alias("eml"))
    with pytest.raises(Exception, match="stop"):
        mail_files.export(bad, str(path))
    assert not list(path.rglob("*.eml"))
