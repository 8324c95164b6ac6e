"""BPE of long texts by tree concatenation, and decoding.

A text of over LEAF_BYTES is halved again and again: where pre-tokens meet, if they do near the middle, and inside a
pre-token where it is a long unsplit one. The leaves of all texts are dealt out and encoded side by side, so one very long
text keeps many tasks busy. Then neighbours are put together, pair by pair up the tree. Two leaves that meet between
pre-tokens are joined as they are. Where they meet inside one, a window around the join, one piece to either side at
first and twice as many each time, is encoded anew, until its first piece is the one that stood there on the left and
its last piece the one on the right.

That is exact: ranked merges give a sequence of pieces exactly if each two neighbours, encoded alone, stay as they are. All
neighbours inside either side and inside the window do, and those at the window's ends are neighbours of one side.

Texts of up to LEAF_BYTES are encoded where they stand, and distinct pre-tokens once in a while only. A text's leaves come
back to one task, which holds the ids of this one text.

Results for odd rows: a null text counts as empty and has no ids; rows with equal or null ids stay apart; columns besides
the id and the text are ignored; an empty table gives no rows. Strings of added tokens inside a text are one id each, as
the library has it by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .vocabulary import encoder, special_strings, spread, vocabulary_path, whole_text_tokenizer
from .wavelet import encode as encode_whole
from .work import kept, quoted, table

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a leaf; a text of no more is one.
LEAF_BYTES = 16 << 10
#: Leaves, and bytes of short texts, that one step encodes.
LEAVES_AT_ONCE, STEP_BYTES = 192, 4 << 20
#: Rows between the steps: a result, or a leaf of a long text (its place, pre-token sizes, how it meets the leaf before).
ROWS = "id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, text_key bigint, place int, bytes binary, sizes array<int>, meets int"
LEAVES = "id {id}, text_key bigint, place int, meets int, ids binary, head int, tail int"
RESULT = "id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: How a leaf meets the one before it: as the first of a text or beside an added token, between pre-tokens, inside one.
APART, BESIDE, INSIDE = 0, 1, 2


@lru_cache(4)
def pieces_of(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {letter: b for b, letter in enumerate(T.byte_letters())}
    named = {i: bytes(map(to_byte.__getitem__, piece)) for piece, i in spec["model"]["vocab"].items()}
    named |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [named[i] for i in range(len(named))]


@lru_cache(4)
def _names(path: str) -> list[str]:
    return [str(i) for i in range(len(pieces_of(path)))]


@lru_cache(4)
def _merging_tokenizer(path: str):
    """The merges alone, over the letters that stand for bytes."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": None, "decoder": None}))


def merged(data: bytes, path: str) -> np.ndarray:
    """Ids of bytes that no pre-token begins or ends inside of; they need not be whole characters."""
    if not data:
        return np.empty(0, np.uint32)
    letters = "".join(map(T.byte_letters().__getitem__, data))
    return np.array(_merging_tokenizer(path).encode(letters, add_special_tokens=False).ids, np.uint32)


# ---------------------------------------------------------------- leaves


def halves(size: int, begins: np.ndarray, leaf_bytes: int) -> list[int]:
    """Where leaves begin in size bytes whose pre-tokens begin at begins: halves of halves, cut between pre-tokens that meet in the middle half."""
    cuts, open_ = [], [(0, size)]
    while open_:
        a, b = open_.pop()
        if b - a <= max(2, leaf_bytes):
            cuts.append(a)
            continue
        middle = (a + b) // 2
        k = int(np.searchsorted(begins, middle))
        near = [int(x) for x in begins[max(0, k - 1) : k + 1] if abs(x - middle) <= (b - a) // 4 and a < x < b]
        cut = min(near, key=lambda x: abs(x - middle)) if near else middle
        open_ += [(cut, b), (a, cut)]
    return cuts


def leaves(text: str, path: str, leaf_bytes: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """(bytes, sizes of pre-tokens and parts of them, how it meets the one before) of the leaves of a text; an added token is a leaf without sizes."""
    marks = special_strings(path)
    parts = re.split("(" + "|".join(map(re.escape, marks)) + ")", text) if marks else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield part.encode(), np.empty(0, np.int32), APART
        elif part:
            data, offsets = T.from_texts([part])
            values, _ = T.byte_level_pretokens(data, offsets)
            begins = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values)]
            cuts = np.array(halves(len(data), begins, leaf_bytes), np.int64)
            inside = ~np.isin(cuts, begins)
            ends = np.append(cuts[1:], len(data))
            for i, (a, b) in enumerate(zip(cuts.tolist(), ends.tolist())):
                own = begins[np.searchsorted(begins, a, "right") : np.searchsorted(begins, b)]
                yield data[a:b].tobytes(), np.diff(np.concatenate([[a], own, [b]])).astype(np.int32), APART if not i else INSIDE if inside[i] else BESIDE


def _digests(ids: np.ndarray, path: str) -> tuple[int, str, str]:
    listed = ids.tolist()
    text = b"".join(map(pieces_of(path).__getitem__, listed)).decode("utf-8", "replace")
    return len(listed), hashlib.sha256(",".join(map(_names(path).__getitem__, listed)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _prepared(batches: Iterator[pa.RecordBatch], path: str, leaf_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of texts that are one leaf, and the leaves of all others."""
    key = TaskContext.get().partitionId() << 32
    for step in T.steps(batches, "text", STEP_BYTES):
        sizes = np.diff(T.utf8(step.column("text"))[1])
        short = np.flatnonzero(sizes <= leaf_bytes)
        if len(short):
            some = step.take(pa.array(short))
            ids, counts = encode_whole(some.column("text"), path)
            ends = np.cumsum(counts)
            found = [_digests(ids[e - n : e], path) for e, n in zip(ends.tolist(), counts.tolist())]
            columns = dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*found)))
            yield _batch({"id": some.column("id"), **columns}, len(some), schema)
        for i in np.flatnonzero(sizes > leaf_bytes).tolist():
            own, held = [], 0
            for place, (data, parts, meets) in enumerate(leaves(step.column("text")[i].as_py(), path, leaf_bytes)):
                own.append((key, place, data, parts, meets))
                held += len(data)
                if held > T.STEP_BYTES:
                    yield _leaf_rows(step.column("id").slice(i, 1), own, schema)
                    own, held = [], 0
            if own:
                yield _leaf_rows(step.column("id").slice(i, 1), own, schema)
            key += 1


def _leaf_rows(id_: pa.Array, own: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    keys, places, data, parts, meets = zip(*own)
    return _batch({"id": id_.take(pa.array(np.zeros(len(own), np.int64))), "text_key": keys, "place": places, "bytes": data, "sizes": parts, "meets": meets}, len(own), schema)


def _batch(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    made = [pa.nulls(n, f.type) if f.name not in columns else columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Ids of leaves; head and tail: how many ids the first and the last pre-token have."""
    added = {mark.encode(): whole_text_tokenizer(path).token_to_id(mark) for mark in special_strings(path)}
    for step in (batch.slice(at, LEAVES_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, LEAVES_AT_ONCE)):
        data, lists = step.column("bytes").to_pylist(), step.column("sizes")
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        sizes = lists.flatten().to_numpy().astype(np.int64)
        # Leaves of added tokens have no sizes; all others lie one after the other, pre-token by pre-token.
        values = T.pieces(np.frombuffer(b"".join(d for d, k in zip(data, n) if k), np.uint8), np.cumsum(sizes) - sizes)
        upto = np.append(0, np.cumsum(n))
        # Pre-tokens at either end of a leaf may be parts that begin inside a character.
        inner = np.ones(len(sizes), bool)
        inner[upto[:-1][n > 0]] = inner[upto[1:][n > 0] - 1] = False
        code, distinct = T.coded(values.filter(pa.array(inner)))
        flat, counts = encoder(path).ids(distinct) if len(distinct) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        ids, places = spread(flat, counts, code), np.append(0, np.cumsum(counts[code]))
        before = np.append(0, np.cumsum(inner))
        rows = []
        for k, d in enumerate(data):
            if not n[k]:
                rows.append((np.array([added[d]], np.uint32), 1, 1))
                continue
            a, b = int(upto[k]), int(upto[k + 1])
            head = merged(values[a].as_py(), path)
            tail = merged(values[b - 1].as_py(), path) if b - a > 1 else head
            middle = ids[places[before[a]] : places[before[b]]]
            rows.append((np.concatenate([head, middle, tail]) if b - a > 1 else head, len(head), len(tail)))
        ids, head, tail = zip(*rows)
        columns = {c: step.column(c) for c in ("id", "text_key", "place", "meets")} | {"ids": [x.astype("<u4").tobytes() for x in ids], "head": head, "tail": tail}
        yield _batch(columns, step.num_rows, schema)
    T.release()


# ---------------------------------------------------------------- joins


def joined(left: np.ndarray, right: np.ndarray, path: str) -> np.ndarray:
    """Ids of the bytes of both sides, which are parts of one pre-token: windows around the join grow until both sides agree."""
    pieces, width = pieces_of(path), 1
    while True:
        a, b = max(0, len(left) - width), min(width, len(right))
        window = merged(b"".join([pieces[i] for i in (*left[a:].tolist(), *right[:b].tolist())]), path)
        if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
            return np.concatenate([left[:a], window, right[b:]])
        width *= 2


def put_together(parts: list[tuple[np.ndarray, int, int, int]], path: str) -> np.ndarray:
    """Ids of a text from those of its leaves (ids, head, tail, how it meets the one before), two neighbours at a time."""
    while len(parts) > 1:
        above = []
        for k in range(0, len(parts), 2):
            if k + 1 == len(parts):
                above.append(parts[k])
                continue
            (x, x_head, x_tail, meets), (y, y_head, y_tail, between) = parts[k], parts[k + 1]
            if between != INSIDE:
                above.append((np.concatenate([x, y]), x_head, y_tail, meets))
                continue
            middle = joined(x[len(x) - x_tail :], y[:y_head], path)
            # A side that lies all in one pre-token gives it on to what stands beyond.
            head = len(middle) if x_head == len(x) else x_head
            tail = len(middle) if y_tail == len(y) else y_tail
            above.append((np.concatenate([x[: len(x) - x_tail], middle, y[y_head:]]), head, tail, meets))
        parts = above
    return parts[0][0] if parts else np.empty(0, np.uint32)


def _text_of_leaves(rows: pa.Table, path: str, schema: pa.Schema) -> pa.Table:
    rows = rows.sort_by("place")
    parts = [(np.frombuffer(x, "<u4"), h, t, m) for x, h, t, m in zip(*(rows.column(c).to_pylist() for c in ("ids", "head", "tail", "meets")))]
    n, of_ids, of_bytes = _digests(put_together(parts, path), path)
    return pa.table({"id": rows.column("id")[:1], "n_tokens": [n], "ids_sha256": [of_ids], "decoded_sha256": [of_bytes]}, schema=schema)


def tree_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row of docs; path is a byte-level tokenizers .json file on every machine."""
    source = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text_column)).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = lambda ddl: _arrow(docs.sparkSession, ddl.format(id=kind))
    rows = kept(source.mapInArrow(partial(_prepared, path=path, leaf_bytes=leaf_bytes, schema=schema(ROWS)), ROWS.format(id=kind)), "leaves")
    parts = rows.where("text_key is not null").select("id", "text_key", "place", "bytes", "sizes", "meets").repartition("text_key", "place")
    parts = parts.mapInArrow(partial(_encoded, path=path, schema=schema(LEAVES)), LEAVES.format(id=kind))
    result = schema(RESULT)
    long = parts.groupBy("text_key").applyInArrow(lambda rows: _text_of_leaves(rows, path, result), RESULT.format(id=kind))
    short = rows.where("text_key is null").select("id", "n_tokens", "ids_sha256", "decoded_sha256")
    return short.unionByName(long).withColumnRenamed("id", id_column)


def _arrow(spark, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).toArrow().schema


def op12_tree_bpe(spark, sf_dir: str) -> DataFrame:
    return tree_digests(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
