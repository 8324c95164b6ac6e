"""Benchmark decontamination: an FM-index over the words of each shard finds test phrases and the spans to remove.

A shard is a run of documents of bounded size in one task, so nothing is shuffled. Its index holds the Burrows-Wheeler
transform of the word numbers as a wavelet matrix and every SAMPLE-th suffix position. Phrases are searched backward,
all at once; the rows found walk back to a sampled position, which gives their places; spans that touch are merged.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. A phrase is WINDOW consecutive words of an item;
an item of fewer words, but not none, is one phrase.

Results for odd rows: a null or empty text has no words and no hits; an item without words has no phrase; items with
equal ids count once; rows with equal or null ids stay apart; columns besides id and text are ignored; empty tables
give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as T
from .wavelet import WaveletMatrix
from .work import quoted, row_of, table

WINDOW = 13
SHARD_BYTES, SAMPLE = 4 << 20, 16
#: Bytes of item texts that go to the tasks at a time (more items go in further blocks), and phrases that are searched together.
ITEM_BYTES = 16 << 20
PHRASES = 1 << 16
#: A document is contaminated if one word in so many lies in a phrase.
SHARE = 20


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes from there: prefix doubling over the suffixes that still tie."""
    n = len(values)
    width = max(1, 62 // max(1, int(values.max(initial=1)).bit_length()))
    key = np.zeros(n, np.int64)
    for k in range(min(width, n)):
        key = key << int(values.max()).bit_length()
        key[: n - k] += values[k:]
    order = np.argsort(key)
    same = np.append(False, key[order][1:] == key[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(same, 0, place))
    depth = min(width, n) or 1
    while True:
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        rows = order[at]
        second = rank[np.minimum(rows + depth, n)]
        by = np.lexsort((second, rank[rows]))
        rows, second = rows[by], second[by]
        first = rank[rows]
        order[at] = rows
        again = np.append(False, (first[1:] == first[:-1]) & (second[1:] == second[:-1]))
        same[at] = again
        rank[rows] = np.maximum.accumulate(np.where(again, 0, at))
        depth *= 2


class FMIndex:
    """Counts and places of word sequences in values (numbers from 1; 0 ends each document)."""

    def __init__(self, values: np.ndarray):
        # Ends of documents differ, so no order depends on what comes after a document.
        ends = values == 0
        n_ends = int(ends.sum())
        distinct = np.where(ends, np.cumsum(ends) - 1, values + n_ends - 1)
        order = suffix_order(distinct)
        self.n = len(values)
        self.before = np.append(0, np.cumsum(np.bincount(values, minlength=int(values.max(initial=0)) + 1)))
        last = values[order - 1]
        self.bwt = WaveletMatrix.build(last, max(1, int(values.max(initial=1)).bit_length()), 64)
        # Walks never cross the end of a document: the first word of each one is sampled too.
        self.sampled = (order % SAMPLE == 0) | (last == 0)
        self.samples = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - self.sampled

    def intervals(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word numbers (0: unknown) the range of suffixes that begin with it."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.flatnonzero((phrases > 0).all(1))
        hi[(phrases == 0).any(1)] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = phrases[live, k]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes: back from word to word up to a sampled one."""
        out, steps, at = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[at[live]]
            found = live[done]
            out[found] = self.samples[self.sample_rank[at[found]]] + steps[found]
            live = live[~done]
            c = self.bwt.access(at[live])
            at[live] = self.before[c] + self.bwt.rank(c, at[live])
            steps[live] += 1
        return out


def phrases_of(items: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray, list]:
    """Distinct words of the items, their texts as numbers of those words, how many words each item has, and their ids; tasks cut the phrases."""
    values, counts = T.words(*T.from_texts([text or "" for _, text in items]))
    codes, distinct = T.coded(values)
    return distinct, codes.astype(np.int32), counts, [i for i, _ in items]


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, with those that touch or overlap put together."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.append(True, begin[1:] > end[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(begin) - 1)
    return begin[fresh], end[last]


def _occurrences(index: FMIndex, known: pa.Array, block: tuple, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths, item numbers) of the phrases of a block that occur; PHRASES of them are searched at a time."""
    words, codes, counts, _ = block
    number = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    own = number[codes]
    length = np.minimum(counts, window)
    n = np.where(counts > 0, counts - length + 1, 0)
    item = np.repeat(np.arange(len(counts)), n)
    begin = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    # A phrase with a word that the shard doesn't have is not searched.
    strange = np.append(0, np.cumsum(own == 0))
    there = strange[begin + length[item]] == strange[begin]
    begin, item = begin[there], item[there]
    for m in np.unique(length[item]).tolist():
        of = np.flatnonzero(length[item] == m)
        for k in range(0, len(of), PHRASES):
            some = of[k : k + PHRASES]
            lo, hi = index.intervals(own[begin[some][:, None] + np.arange(m)])
            met = hi - lo
            rows = np.repeat(lo - (np.cumsum(met) - met), met) + np.arange(met.sum())
            yield index.places(rows), np.full(len(rows), m), np.repeat(item[some], met)


def _lists(owner: np.ndarray, n_rows: int, values: pa.Array) -> pa.Array:
    """A list for each row of the values that it owns; owner ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n_rows + 1)).astype(np.int32)), values)


def _searched(batches: Iterator[pa.RecordBatch], blocks: list, window: int) -> Iterator[pa.RecordBatch]:
    for step in T.steps(batches, "text", SHARD_BYTES):
        words, counts = T.words(*T.utf8(step.column("text")))
        codes, known = T.coded(words)
        m = len(counts)
        ends = np.cumsum(counts + 1)
        values = np.zeros(len(codes) + m, np.int64)
        keep = np.ones(len(values), bool)
        keep[ends - 1] = False
        values[keep] = codes + 1
        index = FMIndex(values)
        begins, finishes, hit_docs, hit_items = [], [], [], []
        for block in blocks:
            content = block.value
            for places, length, items in _occurrences(index, known, content, window):
                begins.append(places)
                finishes.append(places + length)
                doc = np.searchsorted(ends, places, "right")
                pairs = np.unique(np.stack([doc, items]), axis=1) if len(doc) else np.empty((2, 0), np.int64)
                ids = [content[3][i] for i in pairs[1].tolist()]
                hit_docs += [d for d, i in zip(pairs[0].tolist(), ids) if i is not None]
                hit_items += [i for i in ids if i is not None]
            if len(blocks) > 1:
                vars(block).pop("_value", None)  # one block at a time in memory
        begin, end = merged(np.concatenate(begins), np.concatenate(finishes)) if sum(map(len, begins)) else (np.empty(0, np.int64),) * 2
        owner = np.searchsorted(ends, begin, "right")
        base = (ends - counts - 1)[owner]
        found = sorted(set(zip(hit_docs, hit_items)))
        spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["begin", "end"])
        items = _lists(np.array([d for d, _ in found], np.int64), m, pa.array([i for _, i in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([step.column("id"), pa.array(counts.astype(np.int64)), _lists(owner, m, spans), items, *[step.column(c) for c in step.schema.names[2:]]], names=["id", "n_words", "spans", "items", *step.schema.names[2:]])


def _blocks(items: DataFrame, id_column: str, text_column: str) -> list:
    """Broadcast blocks of items, each of about ITEM_BYTES of texts, as word numbers."""
    spark = items.sparkSession
    source = items.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).distinct()
    n = -(-int(source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // ITEM_BYTES) or 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [spark.sparkContext.broadcast(phrases_of([(r["id"], r["text"]) for r in source.where(block == k).collect()])) for k in range(n)]


def phrase_spans(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] = ()) -> DataFrame:
    """For each row of docs: id, n_words, spans (begin, end of words that lie in a phrase) and the items found.

    Columns of docs named in keep, none of them n_words, spans or items, come along.
    """
    blocks = _blocks(items, item_column, item_text)
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"), *[F.col(quoted(c)).alias(f"kept {c}") for c in keep])
    schema = StructType.fromDDL("id bigint, n_words bigint, spans array<struct<begin:bigint,end:bigint>>, items array<bigint>")
    found = source.mapInArrow(partial(_searched, blocks=blocks, window=window), StructType(schema.fields + source.schema.fields[2:]))
    return found.select(F.col("id").alias(id_column), "n_words", "spans", "items", *[F.col(quoted(f"kept {c}")).alias(c) for c in keep])


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (with doc_id and text) without the rows that are contaminated; all columns stay."""
    found = phrase_spans(docs.select("doc_id", "text", row_of(docs)), items, keep=["row"]).withColumn("n_hit", n_hit())
    return found.where(~contaminated()).select("row.*")


def op9_benchmark_phrases(spark, sf_dir: str) -> DataFrame:
    found = phrase_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit())
    names = F.array_sort(F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS phrase FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS k FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM p),
r AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, lengths WHERE len(w) >= m),
h AS (SELECT doc_id, item_id, k, p.m AS m FROM r JOIN p ON p.m = r.m AND p.phrase = array_to_string(w[k : k + r.m - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + m - 1)) AS x FROM h) GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN f ON d.doc_id = f.doc_id
"""
