import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import fingerprint, fm_index, line_spread, ngram_join
from lettermill.llm import text as T

from .helpers import documents, words
from ..oracle import connection, spark_rows, sql_rows


def shingle_set(text):
    w = words(text)
    m = min(5, len(w))
    return frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else None


@pytest.mark.parametrize("block", [2, 1024])
def test_jaccard_classes(spark, small, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    docs = documents(spark, small)
    rows = docs.select("doc_id", "text").collect()
    sets = [shingle_set(r["text"]) for r in rows]
    parent, links = list(range(len(rows))), collections.Counter()

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[top(i)] = min(least.get(top(i), r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), least.get(top(i)), links[i]) for i, r in enumerate(rows))
    got = ngram_join.jaccard_classes(docs).collect()
    assert sorted((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in got) == want
    one_of_each = ngram_join.one_of_each(docs)
    assert one_of_each.columns == docs.columns
    # Of each class with words one row stays, also of repeated rows; rows without words all stay.
    wanted = collections.Counter(str(i) for i in least.values() if i is not None) + collections.Counter()
    heads = {top(i) for i, x in enumerate(sets) if x}
    assert len(heads) + sum(x is None for x in sets) == one_of_each.count()
    assert {str(r["doc_id"]) for r in one_of_each.collect()} == {*wanted, "None"}
    assert ngram_join.jaccard_classes(docs.limit(0)).count() == 0


def test_one_of_each_counts_rows(spark):
    text = "a text of ten words that stands in several rows"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "another text of its own with six more words"), (None, "another text of its own with six more words"), (5, None), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as gone", "2 as `row`", "3 as `a.b`", "4 as key")
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(str(tuple(r)[:2]) for r in got.collect()) == sorted(map(str, [rows[0], rows[4], *rows[6:]]))
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_links_of_one_large_group_stay_few(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 64)
    held = {}
    monkeypatch.setattr(ngram_join, "kept", lambda frame, name, own=ngram_join.kept: held.setdefault(name, own(frame, name)))
    base = [f"w{i}" for i in range(60)]
    n = 400
    rows = [(i, " ".join(base[: i % 60] + [f"x{'abcdefghij'[i % 10]}{'abcdefghijklmnopqrstuvwxyz'[i // 20]}"] + base[i % 60 + 1 :])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.jaccard_classes(docs).collect()
    sets = [shingle_set(t) for _, t in rows]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert [r["n_links"] for r in sorted(got, key=lambda r: r["id"] if "id" in r else r["doc_id"])] == want and {r["class_id"] for r in got} == {0}
    links = held["links"].where("p is not null").count() + held["far-links"].where("p is not null").count()
    assert links < 2 * n


def test_jaccard_classes_with_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 10)
    long = " ".join(f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100))
    docs = spark.createDataFrame([(1, long), (2, long + " one"), (3, long + " two more"), (4, "a text of its own words")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_linked_texts"]) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == {1: (1, 2, 2), 2: (1, 2, 2), 3: (1, 2, 2), 4: (4, 0, 0)}


def test_band_count_reaches_the_recall():
    b = ngram_join.band_count()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** b >= ngram_join.RECALL > 1 - (1 - 0.8**ngram_join.ROWS) ** (b - 1)


def test_suffix_order_and_search():
    made = np.random.default_rng(1)
    for t in range(60):
        v = np.append(made.integers(0, [2, 4, 30][t % 3], made.integers(1, 150)), 0)
        ends = np.cumsum(v == 0)
        d = np.where(v == 0, ends - 1, v + ends[-1] - 1)
        assert fm_index.suffix_order(d).tolist() == sorted(range(len(v)), key=lambda i: d[i:].tolist())
        index = fm_index.FMIndex(v)
        for m in (1, 3):
            phrases = np.array([v[i : i + m] for i in range(len(v) - m) if (v[i : i + m] > 0).all()] + [[1] * m])
            for p, lo, hi in zip(phrases, *index.intervals(phrases)):
                assert sorted(index.places(np.arange(lo, hi)).tolist()) == [i for i in range(len(v) - m + 1) if (v[i : i + m] == p).all()]


@pytest.mark.parametrize("item_bytes", [1 << 24, 2000])
def test_phrase_spans(spark, small, item_bytes, monkeypatch):
    monkeypatch.setattr(fm_index, "ITEM_BYTES", item_bytes)
    docs = documents(spark, small)
    items = spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame([(901, "X Y"), (902, None), (903, ""), (901, "X Y"), (None, "alone")], "item_id bigint, text string"))
    phrases = collections.defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            phrases[tuple(w[i : i + m])].add(r["item_id"])
    sizes = {len(p) for p in phrases}
    want = []
    for r in docs.select("doc_id", "text").collect():
        w, hit, found = words(r["text"]), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if own := phrases.get(tuple(w[i : i + m])):
                    hit |= {*range(i, i + m)}
                    found |= own
        want.append((str(r["doc_id"]), len(w), len(hit), sorted(x for x in found if x is not None)))
    got = fm_index.phrase_spans(docs, items).withColumn("n_hit", fm_index.n_hit()).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(want)
    bad = {i for i, n, h, _ in want if h and 20 * h >= n}
    assert {str(r["doc_id"]) for r in fm_index.decontaminated(docs, items).collect()} == {i for i, *_ in want} - bad
    assert fm_index.decontaminated(docs, items).columns == docs.columns
    assert fm_index.phrase_spans(docs, items.limit(0)).where("size(spans) > 0").count() == 0
    assert fm_index.phrase_spans(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("name", ["op8_spread_lines", "op9_benchmark_phrases"])
def test_sql(spark, small, name):
    from lettermill.llm.registry import ORACLE_SQL, QUERIES

    assert spark_rows(QUERIES[name](spark, small)) == sql_rows(connection(small), ORACLE_SQL[name])


@pytest.mark.parametrize("most", [0, 1 << 19])
def test_line_spread(spark, most, monkeypatch):
    from lettermill.llm import work

    monkeypatch.setattr(work, "SMALL_ROWS", most)
    monkeypatch.setattr(line_spread, "SMALL_ROWS", most)
    line, passage = "We use cookies on this site", " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own text number {i} is here\n  {line} \n\nshort {i}", f"site{i % 6}", 1) for i in range(12)]
    copies = [(100 + i, "a poem of one line\nand one more line", f"site{i % 6}", 1) for i in range(8)]
    longs = [(300 + i, f"text {i} around it\n{passage}", "site0", 1) for i in range(3)]
    odd = [(200, None, "site0", 1), (201, "", "site1", 1), (202, line, None, 1), (None, f"x y z q\n{line}\nmore", "site1", 1), (203, f"a b c\n{line}", "site2", 1), (203, f"a b c\n{line}", "site2", 1)]
    docs = spark.createDataFrame(rows + copies + longs + odd, "doc_id bigint, text string, source string, line int")
    got = line_spread.without_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    found = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in got.collect())
    want = [(str(i), f"own text number {i} is here\n\nshort {i}", 4, 1) for i in range(12)] + [(str(i), t, 2, 0) for i, t, _, _ in copies]
    want += [(str(i), t if i == 300 else t.split("\n")[0], 2, int(i > 300)) for i, t, _, _ in longs]
    want += [("200", None, 0, 0), ("201", "", 1, 0), ("202", "", 1, 1), ("None", "x y z q\nmore", 3, 1), ("203", "a b c", 2, 1), ("203", "a b c", 2, 1)]
    assert found == sorted(want, key=lambda r: (r[0], r[1] or ""))
    assert line_spread.without_repeated_lines(docs.limit(0)).count() == 0
    assert line_spread.without_repeated_lines(docs, min_sites=7, long_words=100).where("n_removed > 0").count() == 0
    clash = docs.selectExpr("*", "7 as n_lines", "8 as `a.b`", "9 as gone")
    assert {r["n_lines"] for r in line_spread.without_repeated_lines(clash, counts=None).collect()} == {7}
    assert line_spread.without_repeated_lines(clash).columns == [*docs.columns, "a.b", "gone", "n_lines", "n_removed"]


def test_lines_over_classes(spark):
    line, passage = "We use cookies on this site and ask all of our readers to accept every one of them before they go on", " ".join(f"word{i}" for i in range(60))
    rows = [(i, " ".join(f"{w}{'abcdef'[i]}" for w in "some own words of text number".split()) + f"\n{line}", f"site{i}") for i in range(6)]
    copies = [(100 + i, "A poem that stands on many sites\nand has a second line of words" + (" " if i % 2 else ""), f"site{i}") for i in range(8)]
    near = [(300 + i, f"{passage}\nand its end number {i}", "site0") for i in range(3)]
    docs = spark.createDataFrame(rows + copies + near, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_spread.without_repeated_lines(docs, over_classes=True).collect()}
    assert got == {**{i: t.split("\n")[0] for i, t, _ in rows}, **{i: t for i, t, _ in copies + near}}


def chunk_loop(data):
    """Chunks of bytes, one byte at a time, with 16 bytes of hash that start afresh at the begin of the text."""
    gear, out, start = fingerprint._gear().tolist(), [], 0
    sums = []
    for i in range(len(data)):
        sums.append(sum(gear[data[j]] << (i - j) for j in range(max(0, i - 15), i + 1)) & 0xFFFFFFFF)
    while start < len(data):
        end = len(data)
        for i in range(start + fingerprint.LEAST - 1, len(data)):
            bits = fingerprint.STRICT_BITS if i < start + fingerprint.NORMAL - 1 else fingerprint.LOOSE_BITS
            if (sums[i] >> 10) % (1 << bits) == 0 or i + 1 == start + fingerprint.MOST:
                end = i + 1
                break
        out.append(data[start:end])
        start = end
    return out


def shared_bytes(one, two):
    a, b = (collections.Counter() for _ in range(2))
    for counts, text in ((a, one), (b, two)):
        for c in chunk_loop(text.encode()):
            counts[c] += len(c)
    if not one or not two:
        return float(one == two)
    return sum(min(n, b[c]) for c, n in a.items()) / min(len(one.encode()), len(two.encode()))


def test_chunks_against_a_loop():
    made = np.random.default_rng(3)
    texts = ["", "a", "short text", "é" * 300, "abab" * 100] + ["".join(made.choice(list("abcdefgh \n"), int(made.integers(1, 900)))) for _ in range(30)]
    data, offsets = T.from_texts(texts)
    starts, owners = fingerprint.chunks(data, offsets)
    ends = np.append(starts[1:], len(data))
    got = [[data[a:b].tobytes() for a, b, o in zip(starts, ends, owners) if o == k] for k in range(len(texts))]
    assert got == [chunk_loop(t.encode()) for t in texts]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_fingerprints(spark, small, ranges):
    docs = documents(spark, small)
    more = spark.createDataFrame([(f"text {i} without an id " * 9,) for i in range(40)], "text string")
    assert fingerprint.fingerprints(more.selectExpr("cast(null as bigint) as doc_id", "text"), ranges=ranges).where("n_chars > 0").count() == 40
    rows = [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = sorted((str(i), len(t), hashlib.sha256(fingerprint.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    got = fingerprint.fingerprints(docs, ranges=ranges).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
    texts, by_text = dict((str(i), t) for i, t in rows), {}
    for r in got:
        assert abs(fingerprint.containment(r["fingerprint"], r["edited_fingerprint"]) - r["near_edited"]) < 1e-9
        assert by_text.setdefault(texts[str(r["doc_id"])], r["fingerprint"]) == r["fingerprint"]
    following = {str(i): rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    for r in got[::7]:
        if r["doc_id"] is not None and r["doc_id"] < 900000:
            one, two = texts[str(r["doc_id"])], following[str(r["doc_id"])]
            assert abs(r["near_next"] - shared_bytes(one, two)) < 1e-9 and abs(r["near_edited"] - shared_bytes(one, fingerprint.edited(one, two))) < 1e-9
    long = [r["near_edited"] for r in got if 1000 < r["n_chars"] < 100000]
    assert np.median(long) > 0.6 and np.median([r["near_next"] for r in got]) < 0.1
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_of_shifted_text():
    made = np.random.default_rng(1)
    text = " ".join("".join(made.choice(list("abcdefgh"), 6)) for _ in range(800))
    a, b = fingerprint.Fingerprints([text]).strings()[0], fingerprint.Fingerprints(["moved along by a few words " + text]).strings()[0]
    assert fingerprint.containment(a, b) > 0.95


@pytest.mark.parametrize("few", [True, False])
def test_components_by_tables(spark, few, monkeypatch):
    """A chain and a ring, whole and one by one: no round takes along what the rounds before it were estimated at, and few edges take few tasks."""
    if not few:
        monkeypatch.setattr(ngram_join, "ONE_TASK", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 200)], "p long, q long")
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup(f"components {few}", "")
    try:
        found = ngram_join.components(edges)
        assert {r["node"]: r["label"] for r in found.collect()} == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(7)} | {200: 200}
        assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
        told = spark.sparkContext.statusTracker()
        stages = {i for j in told.getJobIdsForGroup(f"components {few}") for i in told.getJobInfo(j).stageIds}
        tasks = sum(s.numCompletedTasks for i in stages if (s := told.getStageInfo(i)))
        assert tasks < 200 or not few
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
