"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies.

No id is made for a document. A first pass counts pre-tokens over the whole corpus, and pieces once for each distinct
one. The second pass gathers documents of one task into blocks of bounded size and meets the piece counts in two ways:
the pre-tokens met most often, at most HOT_WORDS of them and none longer than HOT_BYTES, by a broadcast of that
bounded table; all others by a shuffle join, in which a block gives one posting row for each of its rarer pre-tokens
(which of its documents hold it, and how often). Postings come back by block, and sums are made there. The words of a
hot key never travel, so no key gathers more than a small share of the rows.

Results for odd rows: a null text counts as empty; an empty text has no tokens; rows with equal or null ids stay
apart, each with its own count; columns besides the id and the text are ignored; an empty table gives no rows.
Strings of added tokens inside a text count as one token each, as the library does by default.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .vocabulary import encoder, special_strings, vocabulary_path
from .work import kept, most_frequent, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Bounds of a block: bytes of text and documents.
BLOCK_BYTES, BLOCK_DOCS = 12 << 20, 60_000
#: Bounds of the broadcast table.
HOT_WORDS, HOT_BYTES = 1 << 18, 64

POSTINGS = "block bigint, word binary, postings binary, ordinal int, id bigint, n_bytes bigint, n_tokens bigint"


def normalised(text: str) -> str:
    """As the vocabulary's normaliser does: NFC, then lower case without regard to the place in a word."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _block_rows(block: int, parts: list[tuple], heads: list[tuple], hot: tuple[pa.Array, np.ndarray]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("word", pa.large_binary()), ("postings", pa.large_binary()), ("ordinal", pa.int32()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    n = sum(len(h[0]) for h in heads)
    words, texts, times, base = [], [], [], 0
    for values, code, ordinal, count in parts:
        words.append(values)
        texts.append((code + base, ordinal))
        times.append(count)
        base += len(values)
    codes, distinct = T.coded(pa.concat_arrays(words))
    code, ordinal, count = codes[np.concatenate([c for c, _ in texts])], np.concatenate([o for _, o in texts]), np.concatenate(times)
    at = pc.index_in(distinct, value_set=hot[0]).fill_null(-1).to_numpy(zero_copy_only=False)
    known = at[code] >= 0
    n_tokens = np.concatenate([h[2] for h in heads])
    n_tokens += np.bincount(ordinal[known], count[known] * hot[1][at[code[known]]], n).astype(np.int64)
    ids = pa.concat_arrays([h[0] for h in heads])
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.large_binary()), pa.nulls(n, pa.large_binary()), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(np.concatenate([h[1] for h in heads])), pa.array(n_tokens)], schema=schema)
    rare = np.flatnonzero(at < 0)
    distinct = distinct.take(pa.array(rare))
    code, ordinal, count = (np.cumsum(at < 0) - 1)[code[~known]], ordinal[~known], count[~known]
    order = np.argsort(code, kind="stable")
    code, ordinal, count = code[order], ordinal[order], count[order]
    # A count is one byte; a larger one is several entries.
    while (big := count > 255).any():
        code, ordinal, count = np.append(code, code[big]), np.append(ordinal, ordinal[big]), np.append(np.minimum(count, 255), count[big] - 255)
        order = np.argsort(code, kind="stable")
        code, ordinal, count = code[order], ordinal[order], count[order]
    ends = np.searchsorted(code, np.arange(len(distinct)), "right")
    n = np.diff(np.append(0, ends))
    # Each posting: two bytes for each document's place in the block, then one byte for each count.
    flat = np.empty(3 * len(code), np.uint8)
    at = np.repeat(3 * (ends - n), n)
    k = np.arange(len(code)) - np.repeat(ends - n, n)
    flat[at + 2 * k], flat[at + 2 * k + 1] = ordinal & 255, ordinal >> 8
    flat[at + 2 * np.repeat(n, n) + k] = count
    postings = T.pieces(flat, 3 * (ends - n))
    for i in range(0, len(distinct), 20_000):
        m = min(20_000, len(distinct) - i)
        null = lambda kind: pa.nulls(m, kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), distinct.slice(i, m), postings.slice(i, m), null(pa.int32()), null(pa.int64()), null(pa.int64()), null(pa.int64())], schema=schema)


def _segments(texts: list[str], special: re.Pattern) -> tuple[list[str], list[int], np.ndarray]:
    """Normalised parts of the texts between added tokens, the text that each is of, and the added tokens of each text."""
    parts, owner, n_special = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        cut = special.split(t) if "<|" in t else [t]
        n_special[i] = len(cut) - 1
        parts += [normalised(s) for s in cut]
        owner += [i] * len(cut)
    return parts, owner, n_special


def _special(path: str) -> re.Pattern:
    return re.compile("|".join(map(re.escape, special_strings(path))) or r"(?!)")


def _words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of runs of texts, and how often each is there."""
    special = _special(path)
    for step in T.steps(batches, "text", 4 * T.STEP_BYTES):
        held, times = [], []
        for part in T.steps(iter([step]), "text"):
            values, _ = T.word_pretokens(*T.from_texts(_segments([t or "" for t in part.column("text").to_pylist()], special)[0]))
            codes, distinct = T.coded(values)
            held.append(distinct)
            times.append(np.bincount(codes, minlength=len(distinct)))
        codes, distinct = T.coded(pa.concat_arrays(held))
        yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, np.concatenate(times), len(distinct)).astype(np.int64))], names=["word", "n"])


def _postings(batches: Iterator[pa.RecordBatch], path: str, hot: Broadcast) -> Iterator[pa.RecordBatch]:
    special, table_ = _special(path), (pa.array(hot.value[0], pa.large_binary()), hot.value[1])
    partition, block, parts, heads, docs, held = TaskContext.get().partitionId(), 0, [], [], 0, 0
    for step in T.steps(batches, "text"):
        texts = [t or "" for t in step.column("text").to_pylist()]
        sizes = np.diff(T.utf8(step.column("text"))[1])
        if docs and (held + sizes.sum() > BLOCK_BYTES or docs + len(texts) > BLOCK_DOCS):
            yield from _block_rows(partition << 32 | block, parts, heads, table_)
            block, parts, heads, docs, held = block + 1, [], [], 0, 0
        for at in range(0, len(texts), BLOCK_DOCS):
            some = texts[at : at + BLOCK_DOCS]
            if docs + len(some) > BLOCK_DOCS:
                yield from _block_rows(partition << 32 | block, parts, heads, table_)
                block, parts, heads, docs, held = block + 1, [], [], 0, 0
            segments, owner, n_special = _segments(some, special)
            values, n = T.word_pretokens(*T.from_texts(segments))
            codes, distinct = T.coded(values)
            pairs, count = np.unique(codes << 32 | np.repeat(np.array(owner, np.int64), n), return_counts=True)
            parts.append((distinct, pairs >> 32, (pairs & 0xFFFFFFFF) + docs, count))
            heads.append((step.column("id").slice(at, len(some)), sizes[at : at + BLOCK_DOCS], n_special))
            docs, held = docs + len(some), held + int(sizes[at : at + BLOCK_DOCS].sum())
    if docs:
        yield from _block_rows(partition << 32 | block, parts, heads, table_)


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([words, batch.column("n"), pa.array(encoder(path).encoded(words)[1])], names=["word", "n", "n_pieces"])


def _sums(rows: pa.Table) -> pa.Table:
    """Tokens of the documents of one block from all its postings."""
    parts = rows.column("postings").to_pylist()
    flat, sizes = np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))
    n = sizes // 3
    begin = np.repeat(np.cumsum(sizes) - sizes, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ordinal = flat[begin + 2 * k].astype(np.int64) | flat[begin + 2 * k + 1].astype(np.int64) << 8
    tokens = flat[begin + 2 * np.repeat(n, n) + k] * np.repeat(rows.column("n_pieces").to_numpy(), n)
    sums = np.bincount(ordinal, tokens).astype(np.int64)
    at = np.flatnonzero(sums)
    return pa.table({"block": np.full(len(at), rows.column("block")[0].as_py()), "ordinal": at.astype(np.int32), "n": sums[at]})


def _hot(vocabulary: DataFrame, most: int) -> Broadcast:
    """The words met most often (rows word, n, n_pieces), at most about so many."""
    short = vocabulary.where(F.octet_length("word") <= HOT_BYTES)
    rows = short.where(most_frequent(short, "word", "n", most)).select("word", "n_pieces").toArrow()
    return vocabulary.sparkSession.sparkContext.broadcast((rows.column("word").to_pylist(), np.append(rows.column("n_pieces").to_numpy(), 0)))


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """One row (id, n_bytes, n_tokens) for each row of docs; path is a tokenizers .json file on every machine."""
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    counts = source.select("text").mapInArrow(partial(_words, path=path), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = kept(counts.mapInArrow(partial(_pieces, path=path), "word binary, n bigint, n_pieces bigint"), "vocabulary")
    rows = kept(source.mapInArrow(partial(_postings, path=path, hot=_hot(vocabulary, hot_words)), POSTINGS), "postings")
    postings = rows.where("word is not null").select("word", "block", "postings")
    joined = postings.join(vocabulary.select("word", "n_pieces"), "word").select("block", "postings", "n_pieces")
    sums = joined.groupBy("block").applyInArrow(lambda block: _sums(block), "block bigint, ordinal int, n bigint")
    heads = rows.where("word is null").select("block", "ordinal", "id", "n_bytes", "n_tokens")
    return heads.join(sums, ["block", "ordinal"], "left").select(F.col("id").alias(id_column), "n_bytes", (F.col("n_tokens") + F.coalesce("n", F.lit(0))).alias("n_tokens"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
