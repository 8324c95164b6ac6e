"""Toxicity by multiple-instance learning: sentences score, documents are labelled.

A sentence has the logit of a sum of weights of its words' features (word, affixes); a document is toxic if any of its
sentences is: 1 - product of (1 - p). Weights are fitted to document labels through that noisy-or, so training finds which
sentences carry the label, and the same scores locate the offending ones. An L1 penalty keeps the features that explain
more than a few documents. The fit uses a bounded sample of labelled rows (TRAIN_ROWS and TRAIN_BYTES, in the order of a
hash of the id, toxic rows first up to half of it); scoring reads whole texts of all rows and shuffles nothing.

Results for odd rows: a null, empty or wordless text has the score of no evidence (that of one empty sentence); rows
with null labels teach nothing; where labels hold one value only, or none, no words have weight; rows with
equal or null ids stay apart; columns besides those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as T
from .word_features import features
from .work import quoted, row_of, share_of, table

#: Labelled rows that the fit uses at most, about, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 9000, 40 << 20
N_FEATURES = 1 << 18
PREFIXES, SUFFIXES, LEAST_TEXTS = (3, 4, 5, 6, 7, 8), (), 8
#: Steps and rate of the fit; documents of evidence that a feature needs before it gets weight.
STEPS, RATE, LASSO = 120, 0.05, 0.5
THRESHOLD = 0.5

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte where each sentence begins, ascending, and its text: up to a line feed, or . ! ? before white space; an empty text has one."""
    n = len(data)
    blank = np.append(data[1:] <= 32, True) if n else np.empty(0, bool)
    after = np.flatnonzero((data == 10) | (_END[data] & blank)) + 1
    empty = np.diff(offsets) == 0
    begins = np.unique(np.concatenate([offsets[:-1][~empty], after[after < n]]))
    owner = np.concatenate([np.searchsorted(offsets, begins, "right") - 1, np.flatnonzero(empty)])
    begins = np.concatenate([begins, offsets[:-1][empty]])
    # An empty text shares its place with the one after it, which then holds the first sentence there.
    pairs = np.unique(np.stack([owner, begins]), axis=1)
    return pairs[1], pairs[0]


def instances(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, distinct words, the sentence of each word, the text of each sentence, where sentences begin, and where texts do."""
    data, offsets = T.utf8(texts)
    values, counts, at = T.words_at(data, offsets)
    codes, distinct = T.coded(values)
    begins, owner = sentences(data, offsets)
    text_of = np.repeat(np.arange(len(counts)), counts)
    # Order sentences by text, then place: a word's is the last one of its text that begins at or before it.
    key = owner * (len(data) + 1) + begins
    sentence = np.searchsorted(key, text_of * (len(data) + 1) + at, "right") - 1
    return codes, distinct, sentence, owner, begins, offsets


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each sentence, as pairs (sentence, word number); distinct words; texts and begins of sentences; text offsets.

    A word counts once in a sentence, so that one said a thousand times is no stronger evidence than one said once.
    """
    codes, distinct, sentence, owner, begins, offsets = instances(texts)
    pairs = np.unique(sentence * max(1, len(distinct)) + codes)
    return pairs // max(1, len(distinct)), pairs % max(1, len(distinct)), distinct, owner, begins, offsets


class Model:
    """Weights of features and the bias of a sentence."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text; then sentence probabilities, texts of sentences, their begins, and text offsets."""
        sentence, codes, distinct, owner, begins, offsets = bags(texts)
        word = np.zeros(len(distinct))
        if len(distinct):
            found, n = features(distinct, N_FEATURES, PREFIXES, SUFFIXES)
            word = np.add.reduceat(self.weights[found].astype(np.float64), np.cumsum(n) - n)
        logit = self.bias + np.bincount(sentence, word[codes], len(owner))
        clean = np.bincount(owner, -np.logaddexp(0, logit), len(offsets) - 1)
        return -np.expm1(clean), sigmoid(logit), owner, begins, offsets


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


class Sample:
    """Labelled texts as bags of word numbers, gathered part by part; no text is kept, so memory is a few bytes for each word."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.labels: list[np.ndarray] = []
        self.known, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.found: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.texts_with = np.empty(0, np.int64)

    def add(self, texts: pa.Array, labels: np.ndarray) -> None:
        sentence, codes, distinct, owner, _, _ = bags(texts)
        hashed = T.hashes(distinct)
        fresh = np.flatnonzero(~np.isin(hashed, self.known))
        if len(fresh):
            found, n = features(distinct.take(pa.array(fresh)), N_FEATURES, PREFIXES, SUFFIXES)
            self.found.append(found.astype(np.int32))
            self.widths.append(n.astype(np.int32))
            known, numbers = np.append(self.known, hashed[fresh]), np.append(self.numbers, np.arange(len(fresh), dtype=np.int32) + len(self.numbers))
            order = np.argsort(known)
            self.known, self.numbers = known[order], numbers[order]
            self.texts_with = np.append(self.texts_with, np.zeros(len(fresh), np.int64))
        number = self.numbers[np.searchsorted(self.known, hashed)]
        seen = np.unique(owner[sentence] * max(1, len(distinct)) + codes) % max(1, len(distinct))
        np.add.at(self.texts_with, number[seen], 1)
        self.parts.append((sentence.astype(np.int32), number[codes], owner.astype(np.int32)))
        self.labels.append(np.asarray(labels, np.float64))


def fit(sample: Sample, weigh: dict[int, float] | None = None) -> Model:
    """Adam with an L1 step on the likelihood of the document labels under the noisy-or; weigh: of each label, where labels were sampled unevenly."""
    weights, bias = np.zeros(N_FEATURES, np.float32), -4.0
    labels = np.concatenate([np.empty(0), *sample.labels])
    each = np.where(labels > 0, (weigh or {}).get(1, 1.0), (weigh or {}).get(0, 1.0))
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 10)
        return Model(weights, float(np.log(share / (1 - share))))
    found, n = np.concatenate([np.empty(0, np.int32), *sample.found]), np.concatenate([np.empty(0, np.int32), *sample.widths])
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    # A feature that few texts have can't be told from their labels.
    common = np.bincount(found, sample.texts_with[row], N_FEATURES) >= LEAST_TEXTS
    row, found = row[common[found]], found[common[found]]
    used, found = np.unique(found, return_inverse=True)
    found = found.astype(np.int32)
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    mb = vb = 0.0
    total, most = each.sum(), LASSO * each.max() / each.sum()
    for step in range(1, STEPS + 1):
        word = np.bincount(row, w[found], len(n))
        slope_of = np.zeros(len(n))
        gb, at = 0.0, 0
        for (sentence, codes, owner), y in zip(sample.parts, sample.labels):
            logit = bias + np.bincount(sentence, word[codes], len(owner))
            toxic = -np.expm1(np.bincount(owner, -np.logaddexp(0, logit), len(y)))
            slope = sigmoid(logit) * ((1 - y / np.maximum(toxic, 1e-9)) * each[at : at + len(y)] / total)[owner]
            slope_of += np.bincount(codes, slope[sentence], len(n))
            gb, at = gb + slope.sum(), at + len(y)
        g = np.bincount(found, slope_of[row], len(used))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        first, second = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(v / second) + most)
        w -= scale * (m / first)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * most, 0)
        bias -= RATE * (mb / first) / (np.sqrt(vb / second) + 1e-7)
    weights[used] = w
    return Model(weights, float(bias))


def _fitted(batches: Iterator[pa.RecordBatch], weigh: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """The fit to the bounded sample, in one task, so that the driver holds no texts; rows beyond TRAIN_BYTES are left out."""
    sample, held = Sample(), 0
    for step in T.steps(batches, "text"):
        size = int(T.utf8(step.column("text"))[1][-1])
        if held + size <= TRAIN_BYTES:
            held += size
            sample.add(step.column("text"), step.column("toxic").to_numpy(zero_copy_only=False))
    model = fit(sample, weigh)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fits to at most about so many rows of labels (doc_id, toxic), whose crc32(doc_id) mod 5 is not 0, and their texts.

    Toxic rows fill up to half of the sample, and more where clean ones leave room; each label counts by its share of all rows.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    taken = {1: min(toxic, max(most // 2, most - clean)), 0: min(clean, max(most - toxic, most - most // 2))}
    share = {y: taken[y] / max(1, n.get(y, 0)) for y in (0, 1)}
    some = usable.where(F.when(F.col("toxic") == 1, share_of("doc_id", share[1])).otherwise(share_of("doc_id", share[0])))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text", "toxic").select("text", "toxic")
    found = rows.mapInArrow(partial(_fitted, weigh={y: 1 / s for y, s in share.items() if s}), "weights binary, bias double").first()
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"]) if found else fit(Sample())


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    held = model.value
    for step in T.steps(batches, "text"):
        score, p, owner, begins, offsets = held.scores(step.column("text"))
        data = T.utf8(step.column("text"))[0]
        bad = np.flatnonzero(p >= THRESHOLD)
        ends = np.where(np.append(owner[1:] == owner[:-1], False), np.append(begins[1:], 0), offsets[owner + 1])
        upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        place = lambda x: pa.array(upto[x[bad]] - upto[offsets[owner[bad]]])
        spans = pa.StructArray.from_arrays([place(begins), place(ends), pa.array(p[bad])], ["begin", "end", "score"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[bad], np.arange(len(score) + 1)).astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays([pa.array(np.clip(score, 0, 1)), lists, *[step.column(c) for c in step.schema.names[1:]]], names=["score", "offending", *step.schema.names[1:]])


def scored(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] = ()) -> DataFrame:
    """score and offending (begin, end in code points and score of each toxic sentence) for each row, with the columns to keep."""
    source = docs.select(F.col(text_column).alias("text"), *[F.col(quoted(c)).alias(f"kept {c}") for c in keep])
    schema = StructType.fromDDL("score double, offending array<struct<begin:bigint,end:bigint,score:double>>")
    found = source.mapInArrow(partial(_scored, model=docs.sparkSession.sparkContext.broadcast(model)), StructType(schema.fields + source.schema.fields[1:]))
    return found.select(*[F.col(quoted(f"kept {c}")).alias(c) for c in keep], "score", "offending")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score as toxic; all columns stay."""
    found = scored(docs.select("text", row_of(docs)), train(docs, labels), keep=["row"])
    return found.where(F.col("score") < THRESHOLD).select("row.*")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("bigint").alias("n_offending"))
