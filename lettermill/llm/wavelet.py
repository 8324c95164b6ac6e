"""Token ids as succinct files: a wavelet matrix for each shard, in one compressed file that answers queries.

A shard is a run of documents in ascending id order with a bounded number of tokens. Its matrix has one bit plane for
each bit of an id, from the highest; below each plane the ids stand with their zeros first. A shard is one row of a file:
its planes, the number of ones before every 512th bit of each, and the ids and sizes of its documents, so that
access, rank, select, counting and occurrence lookup read a few words only. A task writes all of its shards to one file,
in groups of few shards. Files are Parquet with zstd, so any store that Spark writes to will do.

Results for odd rows: a null text counts as empty and has the end id only; rows with equal ids stand in the order of
their texts, null ids come first; columns besides id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .vocabulary import encoder, special_strings, spread, vocabulary_path, whole_text_tokenizer
from .work import shared_folder, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Tokens after which a shard ends with the document at hand; bits between rank samples.
SHARD_TOKENS, SAMPLE_BITS = 2 << 20, 512
STEP_BYTES = 3 << 20
#: Bytes after which the writer begins another group of shards; it looks at its size after each shard.
GROUP = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}

FILE = "shard bigint, part int, n_tokens bigint, planes array<binary>, ranks array<binary>, ids array<bigint>, sizes array<bigint>"
_ARROW = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


class WaveletMatrix:
    """Bit planes of a sequence of unsigned numbers, with sampled ranks."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], sample: int = SAMPLE_BITS):
        self.n, self.sample = n, sample
        self.planes, self.ranks = [self._padded(p, sample) for p in planes], ranks
        self.zeros = [n - self._total(level) for level in range(len(planes))]

    @classmethod
    def build(cls, values: np.ndarray, n_bits: int, sample: int = SAMPLE_BITS) -> WaveletMatrix:
        if len(values) and int(values.max()) >> n_bits:
            raise ValueError(f"{int(values.max())} does not fit into {n_bits} bits")
        values = np.asarray(values, np.uint16 if n_bits <= 16 else np.uint32)
        planes, ranks = [], []
        for level in range(n_bits):
            bits = (values >> (n_bits - 1 - level) & 1).astype(bool)
            planes.append(np.packbits(bits, bitorder="little"))
            ranks.append(cls.sampled(planes[-1], sample))
            values = np.concatenate([values[~bits], values[bits]])
        return cls(len(values), planes, ranks, sample)

    @staticmethod
    def _padded(plane: np.ndarray, sample: int) -> np.ndarray:
        """The plane as 64-bit words, up to a whole number of samples."""
        out = np.zeros(-(-len(plane) * 8 // sample) * sample // 8, np.uint8)
        out[: len(plane)] = plane
        return out.view("<u8")

    @classmethod
    def sampled(cls, plane: np.ndarray, sample: int) -> np.ndarray:
        """Ones before every sample-th bit."""
        ones = np.bitwise_count(cls._padded(plane, sample)).reshape(-1, sample // 64).sum(1, dtype=np.int64)
        return (np.cumsum(ones) - ones).astype(np.uint32)

    def _total(self, level: int) -> int:
        return int(self._ones(level, np.array([self.n]))[0])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before the places at (0 to n) of a plane."""
        plane = self.planes[level]
        if not len(plane):
            return np.zeros(len(at), np.int64)
        per = self.sample // 64
        block = np.minimum(at // self.sample, len(self.ranks[level]) - 1)
        out = self.ranks[level][block].astype(np.int64)
        for k in range(per):
            word = block * per + k
            left = np.clip(at - 64 * word, 0, 64).astype(np.uint64)
            mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
            out += np.bitwise_count(plane[word] & mask)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the places."""
        at, out = np.asarray(at, np.int64).copy(), np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            bit = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before its place."""
        value, hi = np.asarray(value, np.int64), np.asarray(at, np.int64).copy()
        lo = np.zeros_like(hi)
        for level in range(len(self.planes)):
            bit = (value >> (len(self.planes) - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(bit, self.zeros[level] + a, lo - a), np.where(bit, self.zeros[level] + b, hi - b)
        return np.where(value >> len(self.planes) == 0, hi - lo, 0)

    def count(self, value: int) -> int:
        return int(self.rank(np.array([value]), np.array([self.n]))[0])

    def _select(self, level: int, k: np.ndarray, bit: bool) -> np.ndarray:
        """Places of the ones, or zeros, with the numbers k (from 0) in a plane."""
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            ones = self._ones(level, np.minimum(mid + 1, self.n))
            enough = (ones if bit else np.minimum(mid + 1, self.n) - ones) > k
            open_ = lo < hi
            hi, lo = np.where(open_ & enough, mid, hi), np.where(open_ & ~enough, mid + 1, lo)
        return lo

    def occurrences(self, value: int) -> np.ndarray:
        """All places of a value, ascending."""
        n = self.count(value)
        if not n:
            return np.empty(0, np.int64)
        lo, bits = np.zeros(1, np.int64), []
        for level in range(len(self.planes)):
            bit = bool(value >> (len(self.planes) - 1 - level) & 1)
            ones = self._ones(level, lo)
            lo = self.zeros[level] + ones if bit else lo - ones
            bits.append(bit)
        at = lo[0] + np.arange(n)
        for level in range(len(self.planes) - 1, -1, -1):
            at = self._select(level, at - self.zeros[level] if bits[level] else at, bits[level])
        return np.sort(at)

    def decode(self) -> np.ndarray:
        """The whole sequence: planes from the last to the first put each number back in its place."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty_like(out)
            zeros = self.zeros[level]
            back[~bits] = out[:zeros]
            back[bits] = out[zeros:] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = back
        return out


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts as the library gives them without special tokens, and how many each has."""
    marks = [m.encode() for m in special_strings(path)]
    data, offsets = T.utf8(texts)
    raw = data.tobytes()
    odd = []
    if any(m in raw for m in marks):
        odd = [i for i, t in enumerate(texts.to_pylist()) if t and any(m.decode() in t for m in marks)]
        whole = [None if i in set(odd) else t for i, t in enumerate(texts.to_pylist())]
        data, offsets = T.utf8(pa.array(whole, pa.large_string()))
    values, n = T.byte_level_pretokens(data, offsets)
    codes, distinct = T.coded(values)
    flat, sizes = encoder(path).ids(distinct)
    ids, upto = spread(flat, sizes, codes), np.append(0, np.cumsum(sizes[codes]))
    counts = np.diff(upto[np.append(0, np.cumsum(n))])
    if odd:  # strings of added tokens in a text are the library's own affair
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in odd:
            parts[i] = np.array(whole_text_tokenizer(path).encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            counts[i] = len(parts[i])
        ids = np.concatenate(parts)
    return ids, counts


def _shard_row(shard: int, part: int, n_bits: int, ids: np.ndarray, doc_ids: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    matrix = WaveletMatrix.build(ids, n_bits)
    planes = [p.view(np.uint8)[: -(-len(ids) // 8)].tobytes() for p in matrix.planes]
    return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "n_tokens": [len(ids)], "planes": [planes], "ranks": [[r.astype("<u4").tobytes() for r in matrix.ranks]], "ids": [doc_ids.to_pylist()], "sizes": [sizes.tolist()]}, schema=_ARROW)


def _shards(batches: Iterator[pa.RecordBatch], path: str, n_bits: int) -> Iterator[pa.RecordBatch]:
    part, k, held, docs, counts, n = TaskContext.get().partitionId(), 0, [], [], [], 0
    for step in T.steps(batches, "text", STEP_BYTES):
        ids, sizes = encode(step.column("text"), path)
        ends = np.cumsum(sizes + 1)
        with_end = np.full(int(ends[-1]), END_ID, np.uint32)
        keep = np.ones(len(with_end), bool)
        keep[ends - 1] = False
        with_end[keep] = ids
        held.append(with_end)
        docs.append(step.column("id"))
        counts.append(sizes + 1)
        n += len(with_end)
        if n >= SHARD_TOKENS:
            yield _shard_row(part << 32 | k, part, n_bits, np.concatenate(held), pa.concat_arrays(docs), np.concatenate(counts))
            k, held, docs, counts, n = k + 1, [], [], [], 0
    if n:
        yield _shard_row(part << 32 | k, part, n_bits, np.concatenate(held), pa.concat_arrays(docs), np.concatenate(counts))


def write_token_files(docs: DataFrame, folder: str, path: str, id_column: str = "doc_id", text_column: str = "text", n_bits: int = 16) -> None:
    """Encodes the texts, appends END_ID to each document and writes a file of shards for each range of ids into folder."""
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    ordered = source.repartitionByRange(F.col("id").asc()).sortWithinPartitions("id", "text")
    ordered.mapInArrow(partial(_shards, path=path, n_bits=n_bits), FILE).write.option("compression", "zstd").options(**GROUP).parquet(folder)


def read_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, WaveletMatrix]]:
    """What the row of each shard says, and its matrix."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, WaveletMatrix(row["n_tokens"], [np.frombuffer(x, np.uint8) for x in row.pop("planes")], [np.frombuffer(x, "<u4") for x in row.pop("ranks")])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, matrix in read_matrices(batches):
        ids, sizes = matrix.decode().astype("<u4"), np.array(head["sizes"], np.int64)
        ends = np.cumsum(sizes)
        sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
        m = len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, head["shard"])), pa.array(head["ids"], pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], names=["shard", "id", "place", "n_tokens", "ids_crc32"])


def _found(batches: Iterator[pa.RecordBatch], token: int) -> Iterator[pa.RecordBatch]:
    for head, matrix in read_matrices(batches):
        at = matrix.occurrences(token)
        doc = np.searchsorted(np.cumsum(head["sizes"]), at, "right")
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), head["shard"])), pa.array(head["ids"], pa.int64()).take(pa.array(doc)), pa.array(at)], names=["shard", "id", "place"])


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(folder)


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(shard, id, place in the shard) of all occurrences of a token, from the files."""
    return token_files(spark, folder).mapInArrow(partial(_found, token=token), "shard bigint, id bigint, place bigint")


def read_token_files(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of all documents, from the files; start counts the ids of all documents before."""
    files = token_files(spark, folder)
    shards = files.select("part", "shard", F.col("n_tokens").alias("n"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n_part"))
    # One row for each range of the sort: this window is as small as the number of partitions.
    parts = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("before_part"))
    shards = shards.join(parts, "part").select("shard", (F.col("before_part") + F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).alias("before"))
    rows = files.mapInArrow(_decoded, "shard bigint, id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(shards, "shard").select(F.col("id").alias(id_column), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary_path(VOCABULARY))
    return read_token_files(spark, folder)
