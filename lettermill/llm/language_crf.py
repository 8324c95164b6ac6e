"""Language identification with a linear-chain conditional random field over the words of a text.

Each word has emissions for every language from hashed features (affixes, byte n-grams, the word) and from lexicons, lists of
words that training saw in one language only; learned transitions join neighbours. Forward-backward gives each word
the probability of each language given its whole chain of words, so foreign words within a text keep labels of their
own; a document takes the language of the largest mean probability. A chain is a line of any length.

Training joins stretches of documents of different languages into code-switched runs, next to plain ones, so that
transitions are learned on both. It uses a bounded sample of documents (TRAIN_ROWS and TRAIN_BYTES, in the order of a hash
of the id) in one task; prediction reads whole texts of all rows and shuffles nothing.

Results for odd rows: a text that is null or has no letter is `und` with score 0.0; rows with null languages teach
nothing; with one language in training all texts get it, with none all are `und`; rows with equal or null ids stay apart;
columns besides those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .word_features import features
from .work import share_of, table

#: Labelled documents that the fit uses at most, about, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 2000, 16 << 20
N_FEATURES = 1 << 17
PREFIXES, SUFFIXES, GRAMS = (1, 2, 3), (1, 2, 3, 4), (2, 3)
#: Words of a chain that are worked on at a time; words in a chain of training; share of training runs that switch languages.
RUN, TRAIN_RUN, SWITCHED = 64, 32, 0.5
EPOCHS, BATCH, RATE, DECAY = 3, 512, 0.05, 1e-6
#: Documents of one language, and of no other, in which a word must be to be in a lexicon.
LEXICON_TEXTS = 5


class Model:
    """Languages, weights of features by language, lexicons and transitions."""

    def __init__(self, languages: list[str], weights: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], lexicon_weights: np.ndarray, moves: np.ndarray):
        self.languages, self.weights, self.lexicon, self.lexicon_weights, self.moves = languages, weights, lexicon, lexicon_weights, moves

    def lexicons(self, distinct: pa.Array) -> np.ndarray:
        """The language in whose lexicon each word is, or -1."""
        known, of = self.lexicon
        hashed = T.hashes(distinct)
        if not len(known):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
        return np.where(known[at] == hashed, of[at], -1)

    def emissions(self, distinct: pa.Array) -> np.ndarray:
        found, n = features(distinct, N_FEATURES, PREFIXES, SUFFIXES, GRAMS)
        out = np.add.reduceat(self.weights[found], np.cumsum(n) - n, axis=0) if len(n) else np.empty((0, len(self.languages)), np.float32)
        own = self.lexicons(distinct)
        out = out / np.sqrt(n)[:, None]
        out[own >= 0] += self.lexicon_weights[own[own >= 0]]
        return out

    def marginals(self, emitted: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities of the languages of all words of chains of so many words each."""
        return chain_marginals(emitted, sizes, self.moves)

    def packed(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, languages=np.array(self.languages, np.str_), weights=self.weights, known=self.lexicon[0], of=self.lexicon[1], lexicon_weights=self.lexicon_weights, moves=self.moves)
        return held.getvalue()

    @staticmethod
    def unpacked(held: bytes) -> Model:
        x = np.load(io.BytesIO(held))
        return Model(x["languages"].tolist(), x["weights"], (x["known"], x["of"]), x["lexicon_weights"], x["moves"])


def _scaled(emitted: np.ndarray) -> np.ndarray:
    return np.exp(emitted - emitted.max(1, keepdims=True)) if len(emitted) else emitted


def _passes(psi: np.ndarray, sizes: np.ndarray, step: np.ndarray, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of all words, and where the runs begin.

    entry: the forward message of the word before each run, all zero where none is before; leave: the backward one at its last word.
    """
    n_words, n_lang = psi.shape
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    alpha, beta = np.empty((n_words, n_lang)), np.ones((n_words, n_lang))
    if leave is not None and len(sizes):
        beta[start + size - 1] = leave[order]
    for t in range(longest):
        at = start[: live[t]] + t
        if t:
            a = (alpha[at - 1] @ step) * psi[at]
        else:
            a = psi[at] if entry is None else np.where(entry[order].any(1, keepdims=True), entry[order] @ step, 1.0) * psi[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        b = (psi[at + 1] * beta[at + 1]) @ step.T
        beta[at] = b / b.sum(1, keepdims=True)
    return alpha, beta, start


def forward_backward(emitted: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words, and expected transitions over all runs."""
    n_words, n_lang = emitted.shape
    psi, step = _scaled(emitted), np.exp(moves)
    alpha, beta, start = _passes(psi, sizes, step)
    both = alpha * beta
    both /= np.maximum(both.sum(1, keepdims=True), 1e-300)
    pairs = np.zeros((n_lang, n_lang))
    first = np.ones(n_words, bool)
    first[start] = False
    at = np.flatnonzero(first)
    if len(at):
        joint = alpha[at - 1][:, :, None] * step * (psi[at] * beta[at])[:, None, :]
        pairs = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return both, pairs


def chain_marginals(emitted: np.ndarray, sizes: np.ndarray, moves: np.ndarray, run: int = RUN) -> np.ndarray:
    """Marginals of all words of chains of any length.

    Chains are worked on in runs side by side. Of each run of a long chain the product of its steps is made first; these
    products carry the messages from run to run, so the result is that of the whole chain.
    """
    psi, step = _scaled(emitted), np.exp(moves)
    n_runs = -(-sizes // run)
    chain = np.repeat(np.arange(len(sizes)), n_runs)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    size = np.minimum(run, sizes[chain] - run * place)
    start = np.cumsum(size) - size
    entry, leave = np.zeros((len(chain), psi.shape[1])), np.ones((len(chain), psi.shape[1]))
    long = np.flatnonzero(n_runs[chain] > 1)
    if len(long):
        product = np.broadcast_to(np.eye(psi.shape[1]), (len(long), psi.shape[1], psi.shape[1])).copy()
        for t in range(run):
            live = np.flatnonzero(size[long] > t)
            moved = product[live] if t == 0 else product[live] @ step
            if t == 0:
                later = place[long[live]] > 0
                moved[later] = moved[later] @ step
            moved = moved * psi[start[long[live]] + t][:, None, :]
            product[live] = moved / moved.sum((1, 2), keepdims=True)
        where = np.full(len(chain), -1)
        where[long] = np.arange(len(long))
        last = int(n_runs.max())
        for k in range(1, last):
            r = np.flatnonzero(place == k)
            before = np.where(entry[r - 1].any(1, keepdims=True), entry[r - 1], 1.0)
            a = (before[:, None, :] @ product[where[r - 1]])[:, 0]
            entry[r] = a / a.sum(1, keepdims=True)
        for k in range(last - 1, 0, -1):
            r = np.flatnonzero(place == k)
            b = (product[where[r]] @ leave[r][:, :, None])[:, :, 0]
            leave[r - 1] = b / b.sum(1, keepdims=True)
    alpha, beta, _ = _passes(psi, size, step, entry, leave)
    both = alpha * beta
    return both / np.maximum(both.sum(1, keepdims=True), 1e-300)


def _lexicon(codes: np.ndarray, texts: np.ndarray, gold: np.ndarray, distinct: pa.Array, n_lang: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([codes, texts]), axis=1)
    seen = np.zeros((len(distinct), n_lang), np.int64)
    np.add.at(seen, (pairs[0], gold[pairs[1]]), 1)
    own = np.flatnonzero((seen.max(1) >= LEXICON_TEXTS) & (seen.max(1) == seen.sum(1)))
    hashed = T.hashes(distinct)[own]
    order = np.argsort(hashed)
    return hashed[order], seen[own].argmax(1)[order]


def fit(texts: pa.Array, labels: list[str]) -> Model:
    """Adam on batches of runs; the gradient of a run is expected less observed features and transitions."""
    languages = sorted(set(labels))
    n_lang = len(languages)
    weights, moves = np.zeros((N_FEATURES, n_lang), np.float32), np.zeros((n_lang, n_lang))
    gold = np.array([languages.index(x) for x in labels], np.int64)
    values, counts = T.words(*T.utf8(texts))
    if n_lang < 2 or not len(values):
        return Model(languages, weights, (np.empty(0, np.uint64), np.empty(0, np.int64)), np.zeros((n_lang, n_lang)), moves)
    codes, distinct = T.coded(values)
    text_of = np.repeat(np.arange(len(counts)), counts)
    lexicon = _lexicon(codes, text_of, gold, distinct, n_lang)
    made = np.random.default_rng(11)
    # Plain runs of one document, and runs of stretches of random documents.
    whole = [codes[s : s + TRAIN_RUN] for s in range(0, len(codes), TRAIN_RUN)]
    tags = [gold[text_of[s : s + TRAIN_RUN]] for s in range(0, len(codes), TRAIN_RUN)]
    mixed = int(len(whole) * SWITCHED / (1 - SWITCHED))
    length = made.integers(3, 17, 2 * mixed)
    begin = made.integers(0, np.maximum(1, len(codes) - 16), 2 * mixed)
    for k in range(0, 2 * mixed, 2):
        parts = [slice(begin[i], begin[i] + length[i]) for i in (k, k + 1)]
        whole.append(np.concatenate([codes[p] for p in parts]))
        tags.append(np.concatenate([gold[text_of[p]] for p in parts]))
    found, n = features(distinct, N_FEATURES, PREFIXES, SUFFIXES, GRAMS)
    starts, root = np.cumsum(n) - n, np.sqrt(n)
    model = Model(languages, weights, lexicon, np.zeros((n_lang, n_lang)), moves)
    in_lexicon = model.lexicons(distinct)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    small = [np.zeros((n_lang, n_lang)) for _ in range(4)]
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(made.permutation(len(whole)), -(-len(whole) // BATCH)):
            step += 1
            words, tag = np.concatenate([whole[i] for i in batch]), np.concatenate([tags[i] for i in batch])
            sizes = np.array([len(whole[i]) for i in batch])
            used, inverse = np.unique(words, return_inverse=True)
            width = n[used]
            flat = found[np.repeat(starts[used] - (np.cumsum(width) - width), width) + np.arange(width.sum())]
            emitted = np.add.reduceat(weights[flat], np.cumsum(width) - width, axis=0) / root[used][:, None]
            own = in_lexicon[used]
            emitted[own >= 0] += model.lexicon_weights[own[own >= 0]]
            both, pairs = forward_backward(emitted[inverse], sizes, model.moves)
            both[np.arange(len(tag)), tag] -= 1
            inside = np.ones(len(tag), bool)
            inside[np.cumsum(sizes) - sizes] = False
            at = np.flatnonzero(inside)
            np.add.at(pairs, (tag[at - 1], tag[at]), -1.0)
            by_word = np.stack([np.bincount(inverse, both[:, k], len(used)) for k in range(n_lang)], 1)
            spread = np.repeat(by_word / root[used][:, None], width, axis=0)
            touched, where = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(where, spread[:, k], len(touched)) for k in range(n_lang)], 1) / len(words)
            m[touched] = 0.9 * m[touched] + 0.1 * g
            v[touched] = 0.999 * v[touched] + 0.001 * g * g
            weights[touched] -= RATE * (m[touched] / (1 - 0.9**step) / (np.sqrt(v[touched] / (1 - 0.999**step)) + 1e-8) + DECAY * weights[touched])
            g_lex = np.zeros((n_lang, n_lang))
            np.add.at(g_lex, own[own >= 0], by_word[own >= 0])
            for j, (held, g2) in enumerate(((model.lexicon_weights, g_lex / len(words)), (model.moves, pairs / len(words)))):
                small[2 * j] = 0.9 * small[2 * j] + 0.1 * g2
                small[2 * j + 1] = 0.999 * small[2 * j + 1] + 0.001 * g2 * g2
                held -= RATE * small[2 * j] / (1 - 0.9**step) / (np.sqrt(small[2 * j + 1] / (1 - 0.999**step)) + 1e-8)
    return model


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fit to the bounded sample, in one task; rows beyond TRAIN_BYTES are left out."""
    texts, labels, held = [], [], 0
    for step in T.steps(batches, "text"):
        size = int(T.utf8(step.column("text"))[1][-1])
        if held + size <= TRAIN_BYTES:
            held += size
            texts.append(step.column("text").cast(pa.large_string()))
            labels += step.column("lang").to_pylist()
    model = fit(pa.concat_arrays(texts) if texts else pa.array([], pa.large_string()), labels)
    yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], names=["model"])


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fits to at most about so many rows of docs with a language, whose crc32(doc_id) mod 4 is not 2."""
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    n = usable.count()
    some = usable.where(share_of("doc_id", most / max(n, most)))
    rows = some.select("doc_id", "text", "lang").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text", "lang").select("text", "lang")
    found = rows.mapInArrow(_fitted, "model binary").first()
    model = Model.unpacked(found["model"]) if found else fit(pa.array([], pa.large_string()), [])
    if n and not model.languages:
        raise ValueError("no labelled text fits into TRAIN_BYTES")
    return model


def chains_of(data: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sizes of the chains: the words of one line of one text."""
    lines = np.cumsum(data == 10)
    text = np.repeat(np.arange(len(counts)), counts)
    line = lines[at] if len(at) else at
    fresh = np.append(True, (text[1:] != text[:-1]) | (line[1:] != line[:-1]))[: len(at)]
    return np.diff(np.append(np.flatnonzero(fresh), len(at)))


def _labelled(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    held = model.value
    for step in T.steps(batches, "text"):
        data, offsets = T.utf8(step.column("text"))
        values, counts, at = T.words_at(data, offsets)
        m, n_lang = len(counts), len(held.languages)
        letter = T.classes()[T.code_points(data, offsets)[0]] == T.LETTER if len(data) else np.empty(0, bool)
        _, _, points = T.code_points(data, offsets) if len(data) else (None, None, np.zeros(m + 1, np.int64))
        upto = np.append(0, np.cumsum(letter))
        lettered = np.diff(upto[points]) > 0
        language, score, n_other = np.full(m, -1), np.zeros(m), np.zeros(m, np.int64)
        if n_lang and len(values):
            codes, distinct = T.coded(values)
            probable = held.marginals(held.emissions(distinct)[codes], chains_of(data, at, counts))
            text = np.repeat(np.arange(m), counts)
            mean = np.stack([np.bincount(text, probable[:, k], m) for k in range(n_lang)], 1) / np.maximum(counts, 1)[:, None]
            language = np.where(lettered & (counts > 0), mean.argmax(1), -1)
            score = np.where(language >= 0, mean.max(1), 0.0)
            n_other = np.bincount(text, probable.argmax(1) != language[text], m).astype(np.int64) * (language >= 0)
        names = pa.array([*held.languages, "und"]).take(pa.array(np.where(language < 0, n_lang, language)))
        yield pa.RecordBatch.from_arrays([step.column("id"), names, pa.array(np.clip(score, 0, 1)), pa.array(counts.astype(np.int64)), pa.array(n_other)], names=["id", "lang_pred", "score", "n_words", "n_other_words"])


def languages(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_words, n_other_words: those labelled with another language) for each row of docs."""
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(partial(_labelled, model=shared), "id bigint, lang_pred string, score double, n_words bigint, n_other_words bigint").withColumnRenamed("id", id_column)


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    return languages(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_other_words")
