"""The index after each write against a scan of the living rows."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lettermill.operators import maintenance
from lettermill.operators import search as S
from lettermill.plans import living_index, token_index
from lettermill.schemas import ENVELOPES

WORDS = "harbour tide wind sail rope anchor mast hull deck the and of".split()
CRITERIA = [S.Search(all_words="the tide"), S.Search(any_words="anchor mast"), S.Search(no_words="wind", all_words="the"), S.Search(phrase="the tide"), S.Search(phrase="rope rope"), S.Search(all_words="nowhere tide"), S.Search(any_words="sail", no_words="the and", min_size=3)]


def batches(made):
    seq = 0
    for batch in range(4):
        rows, gone = [], []
        for _ in range(40 if batch == 0 else 12):
            seq += 1
            text = " ".join(made.choice(WORDS) for _ in range(made.randrange(8)))
            rows.append((made.randrange(40), seq, made.choice(WORDS) if made.random() < 0.9 else None, text if made.random() < 0.9 else None, [f"{made.choice(WORDS)}.pdf"] * made.randrange(2)))
        for _ in range(4 if batch else 0):
            seq += 1
            gone.append((made.randrange(40), seq))
        yield batch, rows, gone


def table(spark, log):
    rows = maintenance.current(log)
    columns = [F.col(c.split()[0].strip("`")) if c.split()[0].strip("`") in rows.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0].strip("`")) for c in ENVELOPES.split(", ")]
    return rows.select(*columns)


def test_index_follows_writes(spark, tmp_path, part_rows=60):
    made, root, ops = random.Random(11), str(tmp_path / "index"), []
    schema = "op string, id bigint, seq bigint, subject string, text string, attachments array<string>, account_id bigint, mailbox_id bigint, size bigint"
    for batch, rows, gone in batches(made):
        ops += [("upsert", *r, r[0] % 3, 1, len(r[3] or "")) for r in rows] + [("delete", i, s, None, None, None, None, None, None) for i, s in gone]
        upserts = spark.createDataFrame(rows, "id bigint, seq bigint, subject string, text string, attachments array<string>")
        ended = spark.createDataFrame(gone, "id bigint, seq bigint")
        for _ in range(2):  # a batch that comes twice counts once
            living_index.add(spark, root, batch, upserts, ended, part_rows)
        living = table(spark, spark.createDataFrame(ops, schema))
        index = living_index.LivingIndex(spark, root)
        for c in CRITERIA if batch == 3 else CRITERIA[batch::3]:
            want = sorted(r[0] for r in S.search(living, c).select("id").collect())
            assert sorted(r[0] for r in index.search(living, c).select("id").collect()) == want, (batch, c)
        if batch == 2:
            before = {r["part"]: r["path"] for r in living_index.manifest(spark, root) if r["batch"] == 0}
            due = living_index.merge(spark, root, share=0.4, most=9)
            after = {r["part"]: r["path"] for r in living_index.manifest(spark, root) if r["path"] in before.values()}
            assert after == {p: path for p, path in before.items() if p not in due and p >= 0}


    assert living_index.merge(spark, root, everything=True)
    assert all(r["part"] >= 0 for r in living_index.manifest(spark, root))
    index = living_index.LivingIndex(spark, root)
    for c in CRITERIA[:2]:
        assert sorted(r[0] for r in index.search(living, c).select("id").collect()) == sorted(r[0] for r in S.search(living, c).select("id").collect())


def test_a_write_reads_its_own_rows_only(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = [(k, k, "the", " ".join(f"w{k}x{j}" for j in range(30)), []) for k in range(200)]
    schema = "id bigint, seq bigint, subject string, text string, attachments array<string>"
    living_index.add(spark, root, 0, spark.createDataFrame(rows, schema), None, 500)
    first = living_index.manifest(spark, root)
    assert first[0]["parts"] > 4
    living_index.add(spark, root, 1, spark.createDataFrame([(1, 900, "the", "tide", [])], schema))
    second = living_index.manifest(spark, root)
    new = [r for r in second if r["batch"] == 1]
    assert sum(r["n_rows"] for r in new) == 2 and {r["path"] for r in first} <= {r["path"] for r in second}
    index = living_index.LivingIndex(spark, root)
    # One word's part, not the archive's: its folder of each segment.
    assert len({f.rsplit("/part=", 1)[1].split("/")[0] for f in index.rows(["w7x3"]).inputFiles() if "/part=" in f}) == 1
    assert index.with_all(["w1x1"]).count() == 0 and [r[0] for r in index.with_all(["tide", "the"]).collect()] == [1]
    assert living_index.LivingIndex(spark, str(tmp_path / "none")).with_any(["the"]).count() == 0


def test_postings_are_written_once_in_rounds(spark, tmp_path, monkeypatch):
    schema = "id bigint, seq bigint, subject string, text string, attachments array<string>"
    table = lambda ids, seq: spark.createDataFrame([(k, seq + k, "the Tide", " ".join(f"w{(k * j) % 17} the" for j in range(20)) if k % 5 else None, ["a.pdf"]) for k in ids], schema)
    # Postings come from a message alone; none is moved before it is dealt to its file.
    assert "Exchange" not in token_index.postings(table(range(3), 0))._jdf.queryExecution().executedPlan().toString()
    for name, n in (("ROUND_ROWS", 300), ("MOST_ENDED", 7)):
        monkeypatch.setattr(living_index, name, n, raising=False)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    root, before = str(tmp_path / "index"), spark.conf.get(setting, None)
    second = table(range(30, 70), 1000)
    living_index.add(spark, root, 0, table(range(40), 0), None, 200)
    living_index.add(spark, root, 1, second.union(second.where("id % 3 = 0")).union(table(range(60, 64), 500)), spark.createDataFrame([(k, 2000) for k in range(0, 70, 9)], "id bigint, seq bigint"))
    rows = lambda path: sum(pq.ParquetFile(f).metadata.num_rows for f in path.rglob("*.parquet") if "token" in pq.ParquetFile(f).schema_arrow.names)
    assert rows(tmp_path / "index") == sum(r["n_rows"] for r in living_index.manifest(spark, root))
    want = token_index.postings(table(range(30), 0).union(second).where("id % 9 <> 0"))
    held = lambda frame: sorted((r["token"], r["id"], r["field"], r["positions"]) for r in frame.collect())
    words = ["the", "tide", "a", "pdf", *[f"w{k}" for k in range(17)]]
    assert held(living_index.LivingIndex(spark, root).rows(words)) == held(want)
    assert living_index.merge(spark, root, everything=True) and spark.conf.get(setting, None) == before
    assert held(living_index.LivingIndex(spark, root).rows(words)) == held(want)
    assert sum(r["n_rows"] for r in living_index.manifest(spark, root)) == want.count()
