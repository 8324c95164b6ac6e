import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lettermill.llm import spelling
from lettermill.llm.work import kept, table

from ..oracle import connection, spark_rows, sql_rows

# Null and empty texts, no letters, repeated rows, equal and null ids, letters beyond ASCII, a doubled letter, and a very long word.
ODD = [(1, None), (2, ""), (3, "1 2 \n"), (4, "Straße straße STRASSE Àpfelbäume àpfelbäume"), (4, "Straße straße STRASSE Àpfelbäume àpfelbäume"), (None, "letters letters leters lettters")]
LONG = "abcdefgh" * 40


def variants(rows, errors=199, least=6, often=5, ratio=5):
    """By a loop over all words and places."""
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if errors and h % errors == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    near, masked = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            masked[k, w[:k] + w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: best for w in words if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= ratio * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def found(frame):
    rows = frame.collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {tuple(r) for r in rows}


def test_query_matches_sql(spark, small):
    assert spark_rows(spelling.op11_spelling_variants(spark, small)) == sql_rows(connection(small), spelling.OP11_SQL)


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 900])
def test_variants_match_a_loop(spark, small, filter_bytes):
    """Also with filters dealt into rounds."""
    more = ODD + [(i, f"{LONG} {LONG[:-1]} {LONG[:7]}x{LONG[8:]} winter winters wynter {'winter ' * (i % 7)}") for i in range(20, 29)]
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    docs = docs.selectExpr("doc_id", "text", "1 as id", "2 as word", "3 as n")
    want = variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {"winter", "wynter", LONG, LONG[:-1]} <= {w[0] for w in want} and any(w[1] for w in want)
    assert found(spelling.spelling_variants(spelling.word_counts(docs), filter_bytes=filter_bytes)) == want


def test_chains_and_empty_tables(spark):
    """Forms that rise from word to word, ties, and no rows."""
    counts = spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdfg", 125), ("abcefg", 625), ("abcefh", 625), ("zzzzzz", 4)], "word string, n bigint")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.spelling_variants(counts).collect()}
    assert got == {"abcdef": ("abcdeg", "abcefg", 1), "abcdeg": ("abcdfg", "abcefg", 2), "abcdfg": ("abcefg", "abcefg", 2), "abcefg": (None, "abcefg", 2), "abcefh": (None, "abcefh", 1)}
    assert spelling.spelling_variants(counts.limit(0)).count() == 0
    assert spelling.word_counts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_no_edit_is_lost_by_hashes_and_filters(spark):
    words = ["aabbcc", "straße", "zzzzzz", "abcdef"]
    letters = np.frombuffer("".join(sorted({*"".join(words)})).encode("latin-1"), np.uint8)
    made = defaultdict(int)
    for row, place, letter, hashed in spelling.edits(spelling._matrix(words), letters):
        for i, p, c, h in zip(row.tolist(), place.tolist(), letter.tolist(), hashed.tolist()):
            edit = words[i][:p] + (chr(c) if c else "") + words[i][p + 1 :]
            assert h == spelling.word_hashes([edit])[0]
            made[words[i], edit] += 1
    assert set(made.values()) == {1}
    want = {(w, w[:k] + w[k + 1 :]) for w in words for k in range(6)} | {(w, w[:k] + chr(c) + w[k + 1 :]) for w in words for k in range(6) for c in letters.tolist() if chr(c) > w[k]}
    assert set(made) == want
    known = [f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'x' * (k % 70)}" for k in range(3000)]
    vocabulary = kept(spark.createDataFrame([(w, 5) for w in sorted(set(known))], "word string, n bigint"), "vocabulary")
    rounds = list(spelling.filter_rounds(vocabulary, 2000))
    assert len(rounds) > 1
    for size in {len(w) for w in known}:
        own = spelling.word_hashes([w for w in sorted(set(known)) if len(w) == size])
        assert sum(len(f.holds(size, own)) for f in rounds) == len(own)


def test_checksums_are_those_of_whole_strings():
    words = [b"", b"a", "straße".encode(), b"x" * 100]
    doc, word = np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)
    prefixes = [b":", b"1:", b"123456789:"]
    assert spelling._checksums(prefixes, words, doc, word).tolist() == [zlib.crc32(prefixes[d] + words[w]) for d, w in zip(doc, word)]
