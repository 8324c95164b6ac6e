"""Spelling variants: edits of each word are probed in Bloom filters, and only positives are joined to the vocabulary.

Words are counted over whole texts with map-side sums. The vocabulary (words of LEAST_LENGTH letters and LEAST_COUNT
occurrences at least) is hashed into blocked Bloom filters, one for each word length: a word sets one bit in each of the
eight lanes of one 256-bit block. Spark builds the filters as bitmaps of 4 KB, summed map-side. All filters go to the
tasks together if they hold FILTER_BYTES at most; a larger vocabulary is dealt by hash into rounds, and each round sends
filters of that bound and probes all edits that fall into it, so the broadcast never grows with the data.

Of two near words of one length, the one with the lesser letter where they differ makes the edit; of two words of
different length, the longer one does, by deletion. So each pair is found once, and hashes of edits follow from the
word's own hash: no edit is spelled out until a filter lets it through. Positives meet the vocabulary in an exact join
by the spelled edit, which removes false positives. A word has few hundreds of near words at most, so no key is hot.

A word's form is its near word of largest count, if that is RATIO times its own at least. Forms rise in count by that
ratio, so chains are short, and a bounded number of doublings follows all of them to their roots.

Results for odd rows: a null or empty text has no words; rows with equal ids count each; a null id stands as an empty
string in the typing errors; columns besides the id and the text are ignored; an empty table gives no rows. Words of any
length are handled: those of over LONG letters share a filter and are joined by their digest.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .work import kept, quoted, table

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many of a document, by checksum, is read with a letter left out; 0 for none.
ERRORS = 199
#: Words beyond so many letters share one filter.
LONG = 64
#: Filter bits for a word, and a bound in bytes of all filters sent at a time.
BITS, FILTER_BYTES = 20, 64 << 20
#: Edits that are hashed in one step, and edits that one task probes, about.
STEP_EDITS, TASK_EDITS = 1 << 18, 1 << 27
#: Bytes of a block, its lanes, and bits of a segment, which are those of one bitmap of Spark's.
_BLOCK, _LANES, _SEGMENT_BITS = 32, 8, 1 << 15

# ---------------------------------------------------------------- words


@lru_cache(1)
def _crc_table() -> np.ndarray:
    # Checksums of single bytes hold the table up to the ones that they begin and end with.
    return np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFFFFFFFF ^ 0x00FFFFFF for b in range(256)], np.uint32)


def _checksums(prefixes: list[bytes], words: list[bytes], doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """crc32 of prefix and word for all pairs of places (doc, word): checksums of both are put together, as they are linear."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    state = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes)) ^ np.uint32(0xFFFFFFFF)
    longest = int(min(LONG, size.max())) if len(size) else 0
    # The prefix's checksum carried over n zero bytes, less what zeros alone give.
    carried, zeros, bare = np.empty((longest + 1, len(prefixes)), np.uint32), np.uint32(0xFFFFFFFF), _crc_table()
    for n in range(longest + 1):
        carried[n] = state ^ zeros
        state, zeros = bare[state & np.uint32(0xFF)] ^ (state >> np.uint32(8)), bare[zeros & np.uint32(0xFF)] ^ (zeros >> np.uint32(8))
    out = np.empty(len(doc), np.uint32)
    n = size[word]
    short = n <= longest
    out[short] = carried[n[short], doc[short]] ^ own[word[short]]
    for i in np.flatnonzero(~short).tolist():
        out[i] = zlib.crc32(words[word[i]], zlib.crc32(prefixes[doc[i]]))
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Runs of A-Z, a-z and the letters from U+00C0 to U+00FF, A-Z in lower case, and the text that each is of."""
    low = np.where((data >= 65) & (data < 91), data + 32, data).astype(np.uint8)
    lead = data == 0xC3
    inside = ((low >= 97) & (low < 123)) | lead
    inside[1:] |= lead[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    held = np.cumsum(inside) - inside
    return T.pieces(low[inside], held[at]), np.searchsorted(offsets, at, "right") - 1


def _lengths(words: pa.Array) -> np.ndarray:
    return pc.utf8_length(words.cast(pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], least: int, errors: int) -> Iterator[pa.RecordBatch]:
    """Distinct words of runs of texts, and how often each is there."""
    for step in T.steps(batches, "text", 2 * T.STEP_BYTES):
        values, doc = _runs(*T.utf8(step.column("text")))
        code, distinct = T.coded(values)
        changed: dict[int, dict[bytes, int]] = {}
        times = np.bincount(code, minlength=len(distinct))
        new: list[bytes] = []
        new_times: list[int] = []
        if errors and len(code):
            pair, n = np.unique(doc << 32 | code, return_counts=True)
            prefixes = [f"{'' if i is None else i}:".encode() for i in step.column("id").to_pylist()]
            spelled = distinct.to_pylist()
            sums = _checksums(prefixes, spelled, pair >> 32, pair & 0xFFFFFFFF)
            for i in np.flatnonzero(sums % errors == 0).tolist():
                c = int(pair[i] & 0xFFFFFFFF)
                letters = spelled[c].decode()
                at = int(sums[i]) % len(letters)
                times[c] -= n[i]
                new.append((letters[:at] + letters[at + 1 :]).encode())
                new_times.append(int(n[i]))
        words = pa.concat_arrays([distinct, pa.array(new, pa.large_binary())])
        times = np.append(times, np.array(new_times, np.int64))
        keep = (times > 0) & (_lengths(words) >= least)
        yield pa.RecordBatch.from_arrays([words.filter(pa.array(keep)).cast(pa.large_string()), pa.array(times[keep].astype(np.int64))], names=["word", "n"])


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_LENGTH, errors: int = ERRORS) -> DataFrame:
    """(word, n) of all words of at least so many letters, with the typing errors that checksums choose."""
    source = docs.select(F.col(quoted(id_column)).cast("string").alias("id"), F.col(quoted(text_column)).alias("text"))
    return source.mapInArrow(partial(_counted, least=least, errors=errors), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- hashes of words and of their edits


@lru_cache(1)
def _letter_hashes() -> np.ndarray:
    return np.random.default_rng(199).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _matrix(words: list[str]) -> np.ndarray:
    """The letters of words of one length, a byte each, as all of them lie below U+0100."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _raw(letters: np.ndarray) -> np.ndarray:
    return (_letter_hashes()[letters] * T.powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    """64 bits for each word, that of its edits follow from."""
    out = np.empty(len(words), np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        step = max(1, STEP_EDITS // max(n, 1))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            out[some] = T.mix(_raw(_matrix([words[k] for k in some.tolist()])))
    return out


def edits(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter, hash) of distinct edits of the words in a matrix of letters, in steps of bounded size.

    Deletions have letter 0; replacements put a greater letter of the alphabet, so that a pair comes from one of its words.
    """
    n, size = letters.shape
    for i in range(0, n, max(1, STEP_EDITS // size)):
        part = letters[i : i + max(1, STEP_EDITS // size)]
        weights, value = T.powers(size), _letter_hashes()[part]
        raw = (value * weights).sum(axis=1, dtype=np.uint64)
        # What lies behind a deleted letter moves up by one place.
        before = np.cumsum(value * weights, axis=1, dtype=np.uint64) - value * weights
        moved = value.copy()
        moved[:, 1:] *= weights[:-1]
        after = moved[:, 1:].sum(axis=1, dtype=np.uint64)[:, None] - (np.cumsum(moved, axis=1, dtype=np.uint64) - moved[:, :1])
        last_of_run = np.ones(part.shape, bool)
        last_of_run[:, :-1] = part[:, :-1] != part[:, 1:]
        row, place = np.nonzero(last_of_run)
        yield row + i, place, np.zeros(len(row), np.uint8), T.mix((before + after)[row, place])
        width = max(1, STEP_EDITS // len(part) // max(1, len(alphabet)))
        for j in range(0, size, width):
            row, place, k = np.nonzero(part[:, j : j + width, None] < alphabet)
            place += j
            letter = alphabet[k]
            yield row + i, place, letter, T.mix(raw[row] + (_letter_hashes()[letter] - value[row, place]) * weights[place])


# ---------------------------------------------------------------- filters


class Filters:
    """Blocked Bloom filters by word length, put together from segments; words of one hash lie in one block."""

    def __init__(self, rows: list[tuple[int, int, bytes]], segments: dict[int, int], round_: int, rounds: int):
        self.round, self.rounds, self.segments, self.lanes = round_, rounds, segments, {}
        for size in {r[0] for r in rows}:
            parts, empty = {s: bits for length, s, bits in rows if length == size}, bytes(_SEGMENT_BITS // 8)
            self.lanes[size] = np.frombuffer(b"".join(parts.get(s, empty) for s in range(segments[size])), np.uint32)

    def holds(self, size: int, hashed: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be words of this length and round."""
        lanes = self.lanes.get(shard(size))
        if lanes is None:
            return np.empty(0, np.int64)
        at = np.arange(len(hashed)) if self.rounds == 1 else np.flatnonzero(round_of(hashed, self.rounds) == self.round)
        base = block_of(hashed[at], len(lanes) // _LANES) * _LANES
        for lane in range(_LANES):
            found = (lanes[base + lane] >> lane_bit(hashed[at], lane)) & np.uint32(1) == 1
            at, base = at[found], base[found]
        return at


def shard(size: int) -> int:
    return min(size, LONG + 1)


def round_of(hashed: np.ndarray, rounds: int) -> np.ndarray:
    return (T.mix(hashed) % np.uint64(rounds)).astype(np.int64)


def block_of(hashed: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashed >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)


def lane_bit(hashed: np.ndarray, lane: int) -> np.ndarray:
    return (hashed >> np.uint64(5 * lane) & np.uint64(31)).astype(np.uint32)


def _placed(batches: Iterator[pa.RecordBatch], segments: dict[int, int], rounds: int) -> Iterator[pa.RecordBatch]:
    """For each word the segment of its block, and the places there of the bits that it sets."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        hashed = word_hashes(words)
        size = np.array([shard(len(w)) for w in words], np.int64)
        blocks = np.array([segments[s] for s in size.tolist()], np.uint64) * np.uint64(_SEGMENT_BITS // 8 // _BLOCK)
        block = ((hashed >> np.uint64(40)) * blocks >> np.uint64(24)).astype(np.int64)
        first = block * 8 * _BLOCK % _SEGMENT_BITS
        places = np.stack([first + 32 * lane + lane_bit(hashed, lane) for lane in range(_LANES)], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) * _LANES + 1, _LANES, dtype=np.int32)), pa.array(places.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(round_of(hashed, rounds)), pa.array(size), pa.array(block * 8 * _BLOCK // _SEGMENT_BITS), lists], names=["round", "size", "segment", "places"])
    T.release()


def filter_rounds(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> Iterator[Filters]:
    """Filters over all words, one round after the other; no round holds much more than filter_bytes."""
    sizes = {r[0]: r[1] for r in vocabulary.groupBy(F.least(F.length("word"), F.lit(LONG + 1)).alias("size")).agg(F.count("*")).collect()}
    rounds = max(1, -(-sum(sizes.values()) * BITS // 8 // filter_bytes))
    segments = {s: max(1, -(-n * BITS // rounds // _SEGMENT_BITS)) for s, n in sizes.items()}
    placed = vocabulary.select("word").mapInArrow(partial(_placed, segments=segments, rounds=rounds), "round bigint, size bigint, segment bigint, places array<bigint>")
    bits = placed.select("round", "size", "segment", F.explode("places").alias("place"))
    built = kept(bits.groupBy("round", "size", "segment").agg(F.bitmap_construct_agg("place").alias("bits")), "filters")
    for k in range(rounds):
        yield Filters([tuple(r) for r in built.where(F.col("round") == k).select("size", "segment", "bits").collect()], segments, k, rounds)


# ---------------------------------------------------------------- near words


def join_key(word: str) -> str:
    return word if len(word) <= LONG else "#" + hashlib.sha256(word.encode()).hexdigest()


def _positives(batches: Iterator[pa.RecordBatch], filters: Broadcast, alphabet: str) -> Iterator[pa.RecordBatch]:
    """(key, word, n): edits that a filter lets through, and the words that they come from."""
    letters, held = np.frombuffer(alphabet.encode("latin-1"), np.uint8), filters.value
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n).tolist()
            rows, keys = [], []
            for row, place, letter, hashed in edits(_matrix([words[i] for i in own]), letters):
                at = held.holds(n - (not letter.any()), hashed)
                for i, p, c in zip(row[at].tolist(), place[at].tolist(), letter[at].tolist()):
                    word = words[own[i]]
                    keys.append(join_key(word[:p] + (chr(c) if c else "") + word[p + 1 :]))
                    rows.append(own[i])
                if len(keys) * max(n, 16) >= 1 << 20:
                    yield _pairs(keys, rows, words, counts)
                    rows, keys = [], []
            if keys:
                yield _pairs(keys, rows, words, counts)
    T.release()


def _pairs(keys: list[str], rows: list[int], words: list[str], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([words[i] for i in rows]), pa.array([counts[i] for i in rows], pa.int64())], names=["key", "word", "n"])


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n), both ways, of words of the kept table vocabulary (word, n) that differ by one letter."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    alphabet = "".join(sorted(r[0] for r in letters.collect() if r[0]))
    total = vocabulary.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)) * max(1, len(alphabet)) / 2).first()[0]
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(total / TASK_EDITS))
    long = F.concat(F.lit("#"), F.sha2(F.col("word"), 256))
    known = vocabulary.select(F.when(F.length("word") <= LONG, F.col("word")).otherwise(long).alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = None
    for filters in filter_rounds(vocabulary, filter_bytes):
        sent = spark.sparkContext.broadcast(filters)
        positives = vocabulary.repartition(tasks, "word").mapInArrow(partial(_positives, filters=sent, alphabet=alphabet), "key string, word string, n bigint")
        pairs = kept(positives.join(known, "key").select("word", "n", "other", "other_n"), "near-words")
        sent.unpersist()
        found = pairs if found is None else found.unionByName(pairs)
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def spelling_variants(counts: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of counts (word, n) that are there often enough."""
    vocabulary = kept(counts.where(F.col("n") >= least_count), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(vocabulary, filter_bytes).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = vocabulary.join(near, "word", "left").withColumn("better", -F.col("best.less") >= ratio * F.col("n"))
    rows = kept(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("better"), F.col("best.form")).alias("form"), F.when(F.col("better"), -F.col("best.less")).alias("form_n")), "forms")
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    most = vocabulary.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    # A chain of k forms ends at ratio ** k times the least count at least.
    longest = int(math.log(max(1.0, most / least_count), ratio)) + 1
    for _ in range(math.ceil(math.log2(longest))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = kept(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


def crc32_sql(listed: str) -> str:
    """SQL for the crc32 of a list of byte values. The table of single bytes is linear: what each bit of a byte adds."""
    bits = [zlib.crc32(bytes([(1 << k) ^ 0xFF])) ^ 0xFF000000 for k in range(8)]
    added = "0::UBIGINT"
    for k, b in enumerate(bits):
        added = f"xor({added}, CASE WHEN xor(s, b) & {1 << k} > 0 THEN {b} ELSE 0 END::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {listed}), lambda s, b: xor(s >> 8, {added})), 4294967295::UBIGINT)"


_BYTES = "list_transform(regexp_extract_all(hex(encode(concat(doc_id, ':', word))), '..'), lambda h: ('0x' || h)::UBIGINT)"
OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT word, n, {crc32_sql(_BYTES)}::BIGINT AS h FROM c),
e AS (SELECT CASE WHEN h % {ERRORS} = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT d.word AS a, d.n AS na, v.word AS b, v.n AS nb FROM d JOIN v ON v.word = d.rest),
near AS (SELECT a, na, b, nb FROM p UNION ALL SELECT b, nb, a, na FROM p UNION ALL SELECT x.word, x.n, y.word, y.n FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-nb, b)) AS form, max(nb) AS form_n FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM r GROUP BY 1) USING (word)
"""
