"""Byte-level BPE with Spark's own functions: encoding folds ranked merges, decoding joins binary pieces.

The bytes of a word become an array of piece numbers. The rank map is a literal: an array of small maps, in which a pair of
neighbours lies by a number made of both, as a look-up in one large map would pass over all of its keys. A merge step takes
the least rank of all neighbours, leftmost first, and looks up the two pairs that the merge makes.

Long words are folded in chunks and put together. Two encodings joined are the encoding of both texts if the two pieces at
the seam, taken alone, stay apart; where they don't, a few pieces to either side are folded anew, until both seams
hold. So the work grows with the length of a word, not with its square, and ids are those of the whole word.

Distinct words are counted over the whole corpus. The words met most often, about HOT_WORDS of them and none longer
than HOT_BYTES, are folded once each, and their ids go to the tasks as one value of bounded size. Tasks split texts and look
these words up batch by batch; a document then holds ids and its other words, which are folded where they stand and put
in their places. No text is shuffled, and a document's ids are never spread over rows.

Results for odd rows: a null text counts as empty and has no ids; rows with equal or null ids stay apart; columns
besides the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as T
from .vocabulary import spread, vocabulary_path
from .work import kept, most_frequent, quoted, row_of, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of what is sent to every task besides the rank map.
HOT_WORDS, HOT_BYTES = 1 << 18, 64
#: Bytes of a word that are folded as a whole; bytes of a chunk of a longer one; pieces to either side that a seam is folded anew with.
WHOLE_BYTES, CHUNK_BYTES, SEAM = 64, 32, 8
#: Pieces before a seam that are held back; more than SEAM.
KEPT_PIECES = 16
#: Powers of two.
BUCKETS, PAIR_BUCKETS = 1 << 16, 1 << 17
#: No id: what stands before the first and after the last piece of a word. More than any id: what ranks are lessened by.
EDGE, BELOW = 1 << 19, 1 << 40
#: No id: the place of a word that is not a frequent one.
COLD = -1
_RANKS = "ranks of pieces"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _bucket(piece: Column, buckets: int) -> Column:
    return F.crc32(piece.cast("binary")).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _look_up(maps: Column, piece: Column, buckets: int = BUCKETS) -> Column:
    return F.try_element_at(F.get(maps, _bucket(piece, buckets)), piece)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _as_maps(rows: DataFrame, bucket: Column, buckets: int = BUCKETS) -> Column:
    """One value that maps each key to its value: an array of small maps, in which entries stand in the order of rows' order column. rows: order, key, value."""
    small = rows.groupBy(bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("order", "key", "value"))).alias("entries"))
    filled = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(small, "bucket", "left")
    ordered = filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "entries"))).alias("all"))
    return ordered.select(F.transform("all", lambda x: F.map_from_entries(F.transform(x["entries"], lambda e: F.struct(e["key"], e["value"]))))).scalar()


def _pair(a: Column, b: Column) -> Column:
    """A number for two neighbours; odd and larger than any id, the factor also spreads pairs over the buckets."""
    return a * 1048583 + b


def _pair_bucket(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(PAIR_BUCKETS - 1)).cast("int")


class Ranks:
    """A vocabulary as a value, ranks (whole: ids of pieces; pairs: ids of what two pieces make; bytes: ids of bytes), and the pieces by id, in a list."""

    def __init__(self, spark: SparkSession, path: str):
        ranks = read_ranks(path)
        # Ids run from 0 without a gap, or else the pieces would not stand at the places of their ids.
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("the ranks have gaps")
        names, ids = [p.decode("latin-1") for p in ranks], list(ranks.values())
        literal = spark.createDataFrame(pa.table({"key": pa.array(names), "value": pa.array(ids, pa.int32())})).withColumn("order", F.lit(0))
        # What each piece can be made of: Spark cuts it at all places and keeps the cuts of which both sides are pieces.
        cuts = literal.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))), lambda k: F.struct(F.substring("key", F.lit(1), k).alias("a"), F.substring("key", k + 1, F.length("key")).alias("b")))).alias("cut"))
        side = lambda name: literal.select(F.col("key").alias(f"{name} piece"), F.col("value").cast("bigint").alias(name))
        both = cuts.join(side("a"), F.col("cut.a") == F.col("a piece")).join(side("b"), F.col("cut.b") == F.col("b piece"))
        pairs = kept(both.select(F.lit(0).alias("order"), _pair(F.col("a"), F.col("b")).alias("key"), (F.col("value") - F.lit(BELOW)).alias("value")), "pairs")
        single = F.array(*[F.lit(ranks[bytes([b])]).cast("bigint") for b in range(256)])
        sizes = literal.agg(F.sort_array(F.collect_list(F.struct("value", F.length("key").alias("n")))).alias("all")).select(F.col("all.n")).scalar()
        self.ranks = spark.range(1).select(F.struct(_as_maps(literal, _bucket(F.col("key"), BUCKETS)).alias("whole"), _as_maps(pairs, _pair_bucket(F.col("key")), PAIR_BUCKETS).alias("pairs"), single.alias("bytes"), sizes.alias("sizes"))).scalar()
        self.pieces = sorted(ranks, key=ranks.__getitem__)


def _merged(start: Column, ranks: Column) -> Column:
    """Ranked merges folded over an array of piece numbers.

    The state is one array: the pieces, and between two of them the rank of what they make, less BELOW, or null; so its least
    number is the next merge, and it is a piece's once there is none. Two pieces that stand for nothing keep the ends.
    """
    known = lambda pair: F.try_element_at(F.get(ranks["pairs"], _pair_bucket(pair)), pair)
    rank = lambda a, b: known(_pair(a, b))
    edge, none, rest = F.lit(EDGE).cast("bigint"), F.lit(None).cast("bigint"), F.lit(1 << 30)

    def joined(state: Column, best: Column, i: Column) -> Column:
        # The rank i stands between the pieces i - 1 and i + 1, counted from 1; their other neighbours are i - 3 and i + 3.
        piece = best + BELOW
        made = F.array(rank(F.get(state, i - 4), piece), piece, rank(piece, F.get(state, i + 2)))
        return F.concat(F.slice(state, F.lit(1), i - 3), made, F.slice(state, i + 3, rest))

    def step(state: Column, best: Column) -> Column:
        return F.when(best >= 0, state).otherwise(_let(F.array_position(state, best).cast("int"), lambda i: joined(state, best, i)))

    def folded(p: Column) -> Column:
        pairs = F.zip_with(p, F.slice(p, F.lit(2), rest), lambda a, b: F.array(a, rank(a, b)))
        begin = F.concat(F.array(edge, none), F.flatten(pairs), F.array(edge))
        return F.aggregate(F.slice(p, F.lit(2), rest), begin, lambda state, _: _let(F.array_min(state), lambda best: step(state, best)), lambda state: F.slice(F.array_compact(state), F.lit(2), F.size(F.array_compact(state)) - 2))

    return _let(start, lambda p: F.when(F.size(p) < 2, p).otherwise(folded(p)))


def _numbers(word: Column, ranks: Column) -> Column:
    """The pieces of single bytes of a word given as a byte string."""
    return F.transform(F.split(word, ""), lambda c: F.get(ranks["bytes"], F.ascii(c)))


def _stitched(word: Column, ranks: Column) -> Column:
    """The pieces of a long word: those of its chunks, put together seam by seam."""
    span = lambda x: F.aggregate(x, F.lit(0), lambda n, piece: n + F.get(ranks["sizes"], piece.cast("int")))

    def whole(numbers: Column) -> Column:
        anew = lambda begin, n: _merged(F.slice(numbers, begin + 1, n), ranks)

        def holds(left: Column, right: Column, at: Column) -> Column:
            """Whether the pieces that meet at a byte stay apart when they are folded alone."""
            a, b = F.slice(left, F.lit(-1), F.lit(1)), F.slice(right, F.lit(1), F.lit(1))
            return F.when((F.size(a) == 0) | (F.size(b) == 0), True).otherwise(_let(span(a), lambda n: anew(at - n, n + span(b)) == F.concat(a, b)))

        def seam(left: Column, right: Column, at: Column) -> Column:
            """Both, with SEAM pieces to either side folded anew, where the two seams that this makes hold; else null."""
            head, tail = F.slice(left, F.lit(1), F.greatest(F.size(left) - SEAM, F.lit(0))), F.slice(right, F.lit(SEAM + 1), F.size(right))
            sizes = F.struct(span(F.slice(left, F.greatest(F.size(left) - SEAM + 1, F.lit(1)), F.lit(SEAM))).alias("x"), span(F.slice(right, F.lit(1), F.lit(SEAM))).alias("y"))
            put = lambda z, m: F.when(holds(head, m, at - z["x"]) & holds(m, tail, at + z["y"]), F.concat(head, m, tail))
            return _let(sizes, lambda z: _let(anew(at - z["x"], z["x"] + z["y"]), lambda m: put(z, m)))

        def joined(state: Column, at: Column) -> Column:
            """The state holds the pieces that are sure, in parts, and the last ones, which the next seam may touch; null where a seam fails."""
            left = state["last"]

            both = lambda right: F.when(holds(left, right, at), F.concat(left, right)).otherwise(seam(left, right, at))

            def moved(pieces: Column) -> Column:
                full = F.size(pieces) > 4 * KEPT_PIECES
                sure = F.concat(state["sure"], F.array(F.slice(pieces, F.lit(1), F.size(pieces) - KEPT_PIECES)))
                return F.struct(F.when(full, sure).otherwise(state["sure"]).alias("sure"), F.when(full, F.slice(pieces, F.lit(-KEPT_PIECES), F.lit(KEPT_PIECES))).otherwise(pieces).alias("last"))

            return F.when(left.isNull(), state).otherwise(_let(_let(anew(at, F.lit(CHUNK_BYTES)), both), moved))

        begin = F.struct(F.array().cast("array<array<bigint>>").alias("sure"), F.array().cast("array<bigint>").alias("last"))
        found = F.aggregate(F.sequence(F.lit(0), F.size(numbers) - 1, F.lit(CHUNK_BYTES)), begin, joined, lambda state: F.when(state["last"].isNotNull(), F.flatten(F.concat(state["sure"], F.array(state["last"])))))
        # No seam is known that needs more pieces; the word would be folded as a whole then.
        return F.coalesce(found, _merged(numbers, ranks))

    return _let(_numbers(word, ranks), whole)


def fold_merges(word: Column, ranks: Column, long: bool = True) -> Column:
    """The ids of a word given as a byte string: ranked merges folded over its bytes. long: whether words of over WHOLE_BYTES come."""

    def folded(w: Column) -> Column:
        whole = _merged(_numbers(w, ranks), ranks)
        found = F.when(F.length(w) <= WHOLE_BYTES, whole).otherwise(_stitched(w, ranks)) if long else whole
        return _let(_look_up(ranks["whole"], w), lambda known: F.when(known.isNotNull(), F.array(known)).otherwise(found.cast("array<int>")))

    return _let(word, folded)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of runs of texts, and how often each is there."""
    for step in T.steps(batches, "text", 4 * T.STEP_BYTES):
        codes, distinct = T.coded(T.byte_level_pretokens(*T.utf8(step.column("text")))[0])
        yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))], names=["word", "n"])


def hot_words(docs: DataFrame, vocabulary: Ranks, text_column: str = "text", most: int = HOT_WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words met most often, at most about so many, their ids one after the other, and how many each has."""
    words = docs.select(F.col(quoted(text_column)).alias("text")).mapInArrow(_counted, "word binary, n bigint")
    counts = kept(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.octet_length("word") <= HOT_BYTES), "words")
    hot = counts.where(most_frequent(counts, "word", "n", most)).select("word").repartition("word").withColumn(_RANKS, vocabulary.ranks)
    rows = hot.select("word", _let(F.col(_RANKS), lambda r: fold_merges(F.decode("word", "ISO-8859-1"), r, HOT_BYTES > WHOLE_BYTES)).alias("ids")).toArrow()
    lists = rows.column("ids").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.column("word").to_pylist(), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int32), sizes


def _looked_up(batches: Iterator[pa.RecordBatch], hot: Broadcast) -> Iterator[pa.RecordBatch]:
    """For each text the ids of its frequent words, with COLD in the place of each other one, and those others as byte strings."""
    words, flat, sizes = pa.array(hot.value[0], pa.large_binary()), np.append(hot.value[1], np.int32(COLD)), np.append(hot.value[2], 1)
    for step in T.steps(batches, "text", 3 * T.STEP_BYTES):
        values, n = T.byte_level_pretokens(*T.utf8(step.column("text")))
        codes, distinct = T.coded(values)
        at = pc.index_in(distinct, value_set=words).fill_null(len(words)).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        upto = np.append(0, np.cumsum(sizes[at]))[np.append(0, np.cumsum(n))]
        ids = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(spread(flat, sizes, at), pa.int32()))
        cold = np.flatnonzero(at == len(words))
        others = [w.decode("latin-1") for w in values.take(pa.array(cold)).to_pylist()]
        places = np.searchsorted(cold, np.append(0, np.cumsum(n))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(places), pa.array(others, pa.string())), *[step.column(c) for c in step.schema.names[1:]]], names=["found", "others", *step.schema.names[1:]])


def _in_place(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the documents of a batch, those of other words in their places, and where each document begins (with the end)."""
    found, others = batch.column("found"), batch.column("folded")
    ids = found.flatten().to_numpy(zero_copy_only=False)
    words = others.flatten()
    n, cold = np.ones(len(ids), np.int64), np.flatnonzero(ids == COLD)
    n[cold] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    begin = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int32)
    out[begin] = ids
    out[np.repeat(begin[cold] - (np.cumsum(n[cold]) - n[cold]), n[cold]) + np.arange(n[cold].sum())] = words.flatten().to_numpy(zero_copy_only=False)
    places = np.append(0, np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False)))
    return out, np.append(begin, len(out))[places]


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, places = _in_place(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids, pa.int32()))], names=[*batch.schema.names[2:], "ids"])


def decode(ids: Iterable[int], pieces: list[bytes]) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join([pieces[i] for i in ids])


def _digested(batches: Iterator[pa.RecordBatch], pieces: Broadcast) -> Iterator[pa.RecordBatch]:
    names = [str(i) for i in range(len(pieces.value))]
    for batch in batches:
        ids, places = _in_place(batch)
        of_ids, of_bytes = [], []
        for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
            own = ids[a:b].tolist()
            of_ids.append(hashlib.sha256(",".join([names[i] for i in own]).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(decode(own, pieces.value)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(np.diff(places)), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["kept", "n_tokens", "ids_sha256", "decoded_sha256"])
    T.release()


def _folded(docs: DataFrame, vocabulary: Ranks, text_column: str, keep: Column, most: int) -> DataFrame:
    """found, folded (ids of each other word) and kept for each row of docs."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_words(docs, vocabulary, text_column, most))
    source = docs.select(F.col(quoted(text_column)).alias("text"), keep.alias("kept"))
    schema = StructType(StructType.fromDDL("found array<int>, others array<string>").fields + [source.schema["kept"]])
    # Kept, so that a task never holds two Python workers, one before the fold and one after it.
    looked_up = kept(source.mapInArrow(partial(_looked_up, hot=hot), schema), "looked-up").withColumn(_RANKS, vocabulary.ranks)
    return looked_up.select("found", _let(F.col(_RANKS), lambda r: F.transform("others", lambda w: fold_merges(w, r))).alias("folded"), "kept")


def encode(docs: DataFrame, vocabulary: Ranks, text_column: str = "text", ids_column: str = "ids", most: int = HOT_WORDS) -> DataFrame:
    """docs with the ids of each text, as an array; a null text has none. Words are the matches of public_tokenizers.PATTERN."""
    folded = _folded(docs, vocabulary, text_column, row_of(docs), most)
    found = folded.mapInArrow(_with_ids, StructType([folded.schema["kept"], *StructType.fromDDL("ids array<int>").fields]))
    return found.select(*[F.col(f"kept.{quoted(c)}").alias(c) for c in docs.columns if c != ids_column], F.col("ids").alias(ids_column))


def digests(docs: DataFrame, vocabulary: Ranks, id_column: str = "doc_id", text_column: str = "text", most: int = HOT_WORDS) -> DataFrame:
    """n_tokens, and digests of the ids and of the bytes that they decode to, for each row of docs; most bounds what is sent to tasks."""
    folded = _folded(docs, vocabulary, text_column, F.col(quoted(id_column)), most)
    schema = StructType([folded.schema["kept"], *StructType.fromDDL("n_tokens bigint, ids_sha256 string, decoded_sha256 string").fields])
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary.pieces)
    return folded.mapInArrow(partial(_digested, pieces=pieces), schema).withColumnRenamed("kept", id_column)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), Ranks(spark, vocabulary_path(VOCABULARY)))
