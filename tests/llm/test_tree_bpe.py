import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lettermill.llm import tree_bpe

from .helpers import documents

PATH = P.path(tree_bpe.VOCABULARY)
LETTERS = ["ab", "abcdefghijklmnopqrstuvwxyz", "é中😀", "\n\t  ", "' s t r e v l", "the of and ing ", " \n", "0123456789"]


TOKENIZER = Tokenizer.from_file(PATH)


def library(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def random_texts(n, seed=1):
    made = random.Random(seed)
    for _ in range(n):
        letters = made.choice(LETTERS)
        yield "".join(made.choice(letters) for _ in range(made.randrange(1, 500)))
        yield "".join(made.choice(["<|endoftext|>", " ", "\n", "ab", "'s", "'re", "é", "中", "12", "!!", "  ", "x" * 40]) for _ in range(made.randrange(1, 150)))


@pytest.mark.parametrize("leaf_bytes", [7, 60, tree_bpe.LEAF_BYTES])
def test_digests_are_the_library_s(spark, small, leaf_bytes):
    docs = documents(spark, small).select("doc_id", "text", "id", "score")
    more = list(enumerate(random_texts(60), 930000))
    if leaf_bytes < 1000:  # so many leaves of long texts take long
        docs = docs.where(f"length(text) < {20 * leaf_bytes} or text is null")
    docs = docs.unionByName(spark.createDataFrame([(i, t, 0, 0) for i, t in more], "doc_id bigint, text string, id int, score int"))
    want = sorted((str(r["doc_id"]), *library(r["text"])) for r in docs.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), *r[1:]) for r in tree_bpe.tree_digests(docs, PATH, leaf_bytes=leaf_bytes).collect()) == want
    assert tree_bpe.tree_digests(docs.limit(0), PATH).count() == 0


def test_long_unsplit_texts(spark):
    made = random.Random(9)
    texts = ["".join(made.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "a" * 100_000, "\n" * 100_000 + "x", "é" * 50_000, "中" * 40_000]
    got = {r["doc_id"]: tuple(r)[1:] for r in tree_bpe.tree_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), PATH).collect()}
    assert all(got[i] == library(t) for i, t in enumerate(texts))


def test_windows_at_every_place():
    """Both sides of each cut of a word, in the middle of characters too, give the ids of the whole word."""
    made = random.Random(2)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "éñü中", "etaoinshr"):
        for _ in range(6):
            data = "".join(made.choice(letters) for _ in range(30)).encode()
            whole = tree_bpe.merged(data, PATH)
            for k in range(len(data) + 1):
                assert np.array_equal(tree_bpe.joined(tree_bpe.merged(data[:k], PATH), tree_bpe.merged(data[k:], PATH), PATH), whole)


def test_leaves_are_halves():
    begins = np.array([0, 40, 47, 90])
    cuts = tree_bpe.halves(100, begins, 30)
    assert cuts[0] == 0 and cuts == sorted(set(cuts)) and 47 in cuts
    assert max(np.diff([*cuts, 100])) <= 30
    assert tree_bpe.halves(10, begins[:1], 30) == [0]
