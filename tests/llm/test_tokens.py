import hashlib
import random
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import regex
import tiktoken
from tokenizers import Tokenizer

from lettermill.llm import bpe, text, token_counts, vocabulary, wavelet

from .helpers import documents

MARKS = [" ", "  ", "\n", "'", "'s", "'re", "l", "ll", "a", "Z", "é", "9", "١", "!", "''", "　", "中", "😀", "_", "-", "İ"]


def random_texts(n, seed=1):
    made = random.Random(seed)
    return ["".join(made.choice(MARKS) for _ in range(made.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("split,pattern", [(text.byte_level_pretokens, P.PATTERN), (text.word_pretokens, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")])
def test_pretokens_match_the_pattern(split, pattern):
    texts = [*random_texts(5000), ""]
    values, n = split(*text.from_texts(texts))
    want = [regex.findall(pattern, t) for t in texts]
    assert [len(w) for w in want] == n.tolist() and [x.decode() for x in values.to_pylist()] == [x for w in want for x in w]


@pytest.mark.parametrize("hot", [0, 50, 1 << 18])
def test_token_counts(spark, small, hot):
    docs = documents(spark, small)
    docs = docs.unionByName(docs.limit(1).selectExpr("910000L as doc_id", "'hi<|endoftext|> İΣ don''t <|startoftext|>' as text", *docs.columns[2:]))
    rows = docs.select("doc_id", "text").collect()
    library = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts.token_counts(docs, P.path(token_counts.VOCABULARY), hot_words=hot).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(docs.limit(0), P.path(token_counts.VOCABULARY)).count() == 0


def test_bpe_round_trip_and_library(spark, small):
    docs = documents(spark, small)
    made = random.Random(3)
    more = ["".join(made.choice("abcdetionsrl0123é中😀'\n ") for _ in range(200)) for _ in range(30)] + ["a" * 3000, "".join(made.choice("abcXYZ019+/") for _ in range(1500))]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 920000)), "doc_id bigint, text string"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((str(r["doc_id"]), len(ids), digest(",".join(map(str, ids)).encode()), digest((r["text"] or "").encode())))
    vocabulary = bpe.Ranks(spark, P.path(bpe.VOCABULARY))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, vocabulary).collect()]
    assert sorted(got) == sorted(want)
    few = bpe.encode(docs.limit(40), vocabulary, most=100)
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") for r in few.select("text", "ids").collect())
    assert bpe.digests(docs.limit(0), vocabulary).count() == 0


def test_bpe_of_long_words(spark):
    """Seams of chunks, and a word of 200,000 letters."""
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    made = random.Random(7)
    words = ["".join(made.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "etaoinshr", "éñü中") for n in (65, 100, 333, 2000)] + ["a" * 3000, "the" * 500, "ing" * 200]
    words.append("".join(made.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)))
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, bpe.Ranks(spark, P.path(bpe.VOCABULARY))).collect()}
    assert time.time() - began < 60
    assert all(got[i] == library.encode_ordinary(w) for i, w in enumerate(words))


@pytest.mark.parametrize("shard", [wavelet.SHARD_TOKENS, 5000])
def test_token_files(spark, small, tmp_path, shard, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", shard)
    docs = documents(spark, small)
    rows = sorted(((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    library = Tokenizer.from_file(P.path(wavelet.VOCABULARY))
    want, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, wavelet.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    wavelet.write_token_files(docs, folder, P.path(wavelet.VOCABULARY))
    got = sorted((tuple(r) for r in wavelet.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    token = library.encode(" of", add_special_tokens=False).ids[0]
    counted = sum(library.encode(t, add_special_tokens=False).ids.count(token) for _, t in rows)
    assert wavelet.find_token(spark, folder, token).count() == counted > 0
    empty = f"{tmp_path}/{uuid.uuid4().hex}"
    wavelet.write_token_files(docs.limit(0), empty, P.path(wavelet.VOCABULARY))
    assert wavelet.read_token_files(spark, empty).count() == 0


def test_ids_that_do_not_fit_are_an_error():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([1, 70_000]), 16)


def test_encoder_keeps_words_of_late(monkeypatch):
    monkeypatch.setattr(vocabulary, "KEPT_WORDS", 60)
    path = P.path(wavelet.VOCABULARY)
    library, held, made = Tokenizer.from_file(path), vocabulary.PretokenEncoder(path), random.Random(5)
    for _ in range(30):
        words = list(dict.fromkeys(" " + "".join(made.choice("abé") for _ in range(made.randrange(1, 5))) for _ in range(made.randrange(1, 40))))
        ids, n = held.ids(pa.array([w.encode() for w in words], pa.large_binary()))
        want = [library.encode(w, add_special_tokens=False).ids for w in words]
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
        assert len(held.known) <= 60 + len(words)


@pytest.mark.parametrize("sample", [64, 512])
def test_wavelet_matrix(sample):
    v = np.random.default_rng(2).integers(0, 70, 3000)
    m = wavelet.WaveletMatrix.build(v, 16, sample)
    assert (m.decode() == v).all() and (m.access(np.arange(len(v))) == v).all()
    for c in (*range(71), 40000):
        assert m.count(c) == (v == c).sum() and (m.occurrences(c) == np.flatnonzero(v == c)).all()
        assert m.rank(np.array([c]), np.array([1500]))[0] == (v[:1500] == c).sum()


def test_hashes_do_not_depend_on_the_batch():
    a = text.hashes(pa.array([b"x", b"yy", b"", b"zzz"], pa.large_binary()))
    b = text.hashes(pa.array([b"q", b"zzz", b"x"], pa.large_binary()))
    assert a[0] == b[2] and a[3] == b[1] and len({*a.tolist()}) == 4
