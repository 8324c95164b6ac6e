"""Document fingerprints by content-defined chunking.

A gear hash of the last bytes sets boundaries that move along with the text; with normalised chunking they are rare
before NORMAL bytes and frequent after. The fingerprint of a text is its set of chunk digests with the bytes that each
one covers; the likeness of two texts is the bytes that they share over the bytes of the shorter one (containment). An
insertion or a cut changes only the chunks that it touches.

The edited text of a document takes the end of the next one: documents are dealt into ranges of ids, in each of which one task
reads them in descending order; the first document of a range also goes to the range before it, so that each
document meets the next one without any global window.

Results for odd rows: a null text counts as empty; an empty text has an empty fingerprint, like 1.0 to another empty one
and 0.0 to any other; null ids come last; rows with equal ids stand in the order of a hash of their texts; columns besides id and text
are ignored; the only row of a table is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .work import table

#: Bytes of a chunk: the least, where the mask loosens, and the most; bits that must be zero before and after NORMAL.
LEAST, NORMAL, MOST, STRICT_BITS, LOOSE_BITS = 12, 40, 160, 6, 4
#: Bytes of text in a range of ids, about, at most.
RANGE_BYTES = 256 << 20
_ENTRY = 18  # hex digits of an entry: five bytes of digest, four of length

RESULT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lru_cache(1)
def _gear() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of all texts begin, ascending, and the text that each one is of."""
    n = len(data)
    sizes = np.diff(offsets)
    place = np.arange(n, dtype=np.int32) - np.repeat(offsets[:-1], sizes).astype(np.int32)
    h = _gear()[data]
    for m in (1, 2, 4, 8):  # the hash of 2 m bytes from two of m bytes
        back = np.zeros(n, np.uint32)
        back[m:] = h[:-m] << np.uint32(m)
        back[place < m] = 0
        h = h + back
    mixed = h >> np.uint32(10)
    at = np.arange(n + 1, dtype=np.int64)

    def following(bits: int) -> np.ndarray:
        """For each byte the first one from there on with so many zero bits; n if there is none."""
        hit = np.where(np.append(mixed & np.uint32((1 << bits) - 1) == 0, False), at, n)
        return np.minimum.accumulate(hit[::-1])[::-1]

    strict, loose = following(STRICT_BITS), following(LOOSE_BITS)
    owner = np.flatnonzero(sizes > 0)
    start, end = offsets[owner], offsets[owner + 1]
    starts, owners = [], []
    while len(start):
        starts.append(start)
        owners.append(owner)
        a = strict[np.minimum(start + LEAST - 1, n)] + 1
        b = loose[np.minimum(start + NORMAL - 1, n)] + 1
        cut = np.where(a < start + NORMAL, a, np.minimum(b, start + MOST))
        open_ = cut < end
        start, end, owner = cut[open_], end[open_], owner[open_]
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, owners = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(starts)
    return starts[order], owners[order]


class Fingerprints:
    """Distinct chunk digests of texts, by text and digest, with the bytes that each one covers."""

    def __init__(self, texts: list[str]):
        data, offsets = T.from_texts(texts)
        starts, owners = chunks(data, offsets)
        digests = T.hashes(T.pieces(data, starts)) >> np.uint64(24)
        sizes = np.diff(np.append(starts, len(data)))
        self.key, where = np.unique(owners.astype(np.uint64) << np.uint64(40) | digests, return_inverse=True)
        self.size = np.bincount(where, sizes, len(self.key)).astype(np.int64)
        self.bytes = np.diff(offsets)
        self.begin = np.searchsorted(self.key >> np.uint64(40), np.arange(len(texts) + 1))

    def strings(self) -> list[str]:
        digest = (self.key & np.uint64(2**40 - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
        size = self.size.astype(">u4").view(np.uint8).reshape(-1, 4)
        digits = np.concatenate([digest, size], axis=1).tobytes().hex()
        return [digits[a * _ENTRY : b * _ENTRY] for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist())]


def likeness(a: Fingerprints, b: Fingerprints, shift: int, n: int) -> np.ndarray:
    """For the first n texts of a: containment with the text of b that stands so much further on."""
    inside = b.key >> np.uint64(40) >= shift
    key, size = b.key[inside] - np.uint64(shift << 40), b.size[inside]
    _, i, j = np.intersect1d(a.key, key, assume_unique=True, return_indices=True)
    shared = np.bincount((a.key[i] >> np.uint64(40)).astype(np.int64), np.minimum(a.size[i], size[j]), max(n, len(a.bytes)))[:n]
    one, two = a.bytes[:n], b.bytes[shift : shift + n]
    least = np.minimum(one, two)
    return np.where(np.maximum(one, two) == 0, 1.0, np.where(least == 0, 0.0, shared / np.maximum(least, 1)))


def containment(one: str, two: str) -> float:
    """The likeness of two fingerprints as strings."""
    sets = [{x[i : i + 10]: int(x[i + 10 : i + _ENTRY], 16) for i in range(0, len(x), _ENTRY)} for x in (one, two)]
    if not sets[0] or not sets[1]:
        return float(not sets[0] and not sets[1])
    return sum(min(n, sets[1].get(d, 0)) for d, n in sets[0].items()) / min(sum(s.values()) for s in sets)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the begin of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _rows(run: list[tuple[int, str]]) -> pa.RecordBatch:
    """Results of all but the last document of the run."""
    texts = [t for _, t in run]
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
    own, after, n = Fingerprints(texts), Fingerprints(changed), len(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in run[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(own.strings()[:n]),
            pa.array(after.strings()),
            pa.array(likeness(own, after, 0, n)),
            pa.array(likeness(own, own, 1, n)),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, held, last = [], 0, None
    for step in T.steps(batches, "text"):
        for i, t, bucket, extra in zip(*(step.column(c).to_pylist() for c in ("id", "text", "bucket", "extra"))):
            if extra and last == (bucket, 1):
                continue  # one document after the range is enough
            run.append((i, t or ""))
            held += 4 * len(t or "")
            if extra or held > 4 * T.STEP_BYTES and len(run) > 1:
                if len(run) > 1:
                    yield _rows(run)
                run = [] if extra else run[-1:]
                held = sum(4 * len(t) for _, t in run)
            last = (bucket, extra)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    ranges: parts of the ids that are read side by side; by default twice the shuffle partitions, and more where one would hold over RANGE_BYTES.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    source = source.withColumns({"tie": F.coalesce(F.xxhash64("text"), F.lit(0)), "place": F.col("id").cast("double")})
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    total, of_none = source.agg(size, F.coalesce(F.sum(F.when(F.col("id").isNull(), F.octet_length("text"))), F.lit(0))).first()
    ranges = max(ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(source.select("place").where("place is not null").approxQuantile("place", shares, max(0.2 / ranges, 1e-6)))) if shares else []
    bucketed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="dealt", handleInvalid="keep").transform(source) if cuts else source.withColumn("dealt", F.lit(0.0))
    # Ranges in the order of reading: descending ids; null ids at the end, in ranges of their hashes.
    more = 1 + ranges * of_none // max(1, total)
    none = F.lit(len(cuts) + 1) + F.least(F.floor((0.5 - F.col("tie") / 2.0**64) * more), F.lit(more - 1)).cast("int")
    source = bucketed.withColumn("bucket", F.when(F.col("id").isNull(), none).otherwise(F.lit(len(cuts)) - F.col("dealt").cast("int"))).drop("place", "dealt")
    first = sorted((r["bucket"], r["first"]["id"], r["first"]["tie"]) for r in source.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("first")).collect())
    # One row for each range: the first document there, and the range before, for which it is the next one.
    heads = spark.createDataFrame([(b, i, t, first[k - 1][0]) for k, (b, i, t) in enumerate(first)], "bucket int, head_id bigint, head_tie bigint, before int")
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    place = lambda bucket, extra: F.struct(F.col(bucket).alias("bucket"), F.lit(extra).alias("extra"))
    dealt = source.join(F.broadcast(heads), "bucket").select("id", "text", "tie", F.explode(F.when(is_head, F.array(place("bucket", 0), place("before", 1))).otherwise(F.array(place("bucket", 0)))).alias("at"))
    dealt = dealt.select("id", "text", "tie", "at.bucket", "at.extra")
    # A task for each range.
    ordered = dealt.repartitionById(len(cuts) + 1 + more, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("id").desc_nulls_last(), F.col("tie").desc())
    return ordered.select("id", "text", "bucket", "extra").mapInArrow(_in_order, RESULT).withColumnRenamed("id", id_column)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
