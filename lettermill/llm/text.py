"""Array helpers the operators share: whole texts of an Arrow batch as flat NumPy arrays.

Nothing here keeps state between batches, so a task can be run again after a lost executor.
Null texts count as empty ones everywhere in this module.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa

#: Text bytes that one step of an operator holds at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 20

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def steps(batches: Iterator[pa.RecordBatch], column: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most step_bytes of text (one row at least)."""
    for batch in batches:
        sizes = np.diff(utf8(batch.column(column))[1])
        start = 0
        while start < batch.num_rows:
            held = np.cumsum(sizes[start:])
            n = max(1, int(np.searchsorted(held, step_bytes, "right")))
            yield batch.slice(start, n)
            start += n
    release()


def release() -> None:
    """Gives back what a worker holds but no longer uses, as it may stand idle beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (with the end at last)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def from_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


def pieces(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values that begin at starts and run on to the next one."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the distinct values that the numbers stand for."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


# ---------------------------------------------------------------- words of ASCII letters, digits and all beyond ASCII

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased, and how many each text has."""
    return words_at(data, offsets)[:2]


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """words(), and the byte where each word begins."""
    low = _LOWER[data]
    inside = _IN_WORD[low]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    begins = inside & ~before
    at = np.flatnonzero(begins)
    # Once all else has gone, each word begins after as many bytes as words held before it.
    kept = np.cumsum(inside) - inside
    counts = np.diff(np.searchsorted(at, offsets))
    return pieces(low[inside], kept[at]), counts, at


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240131)
    return made.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), made.integers(1, 2**63, 1, dtype=np.uint64) * np.uint64(8) + np.uint64(5)


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    base = _tables()[1]
    powers = np.ones(n, np.uint64)
    if n > 1:
        powers[1:] = np.cumprod(np.repeat(base, n - 1))
    return powers


def powers(n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    size = 1 << max(6, int(n - 1).bit_length())
    return _powers(size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary value; the same in every batch and process."""
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    if not n or offsets[-1] == offsets[0]:
        return mix(np.zeros(n, np.uint64) + np.uint64(1))
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    summed = np.zeros(n, np.uint64)
    full = sizes > 0
    summed[full] = np.add.reduceat(_tables()[0][data] * powers(int(sizes.max()))[place], offsets[:-1][full])
    return mix(summed + sizes.astype(np.uint64))


def shingles(hashed: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of size words for texts of so many words each, and how many runs each text has.

    A text of fewer words, but not none, has one run of all of them.
    """
    width = np.minimum(counts, size)
    n = np.where(counts > 0, counts - width + 1, 0)
    base = np.concatenate([[0], np.cumsum(counts)])[:-1]
    first = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(width, n)
    out = wide.astype(np.uint64)
    for k in range(size):
        part = out * powers(2)[1]
        inside = wide > k
        if inside.all():
            out = part + hashed[first + k]
        else:
            out = part
            out[inside] += hashed[first[inside] + k]
    return mix(out), n


# ---------------------------------------------------------------- pre-tokens of the public byte-level tokenizers


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for each code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte where each begins, and the number of the first one of each text."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    return points, at, np.searchsorted(at, offsets)


def _contractions(points: np.ndarray, begins: np.ndarray, alone: np.ndarray, last: np.ndarray) -> None:
    """Moves the begin after an apostrophe that stands alone behind the letters of 's 't 're 've 'm 'll 'd."""
    i = np.flatnonzero(alone & begins & (points == 39))
    at = lambda k: np.where(i + k <= last[i], points[np.minimum(i + k, len(points) - 1)], 0)
    one, two = at(1), at(2)
    pair = lambda a, b: (one == ord(a)) & (two == ord(b))
    long = pair("r", "e") | pair("v", "e") | pair("l", "l")
    short = np.isin(one, [ord(c) for c in "stmd"])
    size = np.where(short, 2, np.where(long, 3, 0))
    i, size = i[size > 0], size[size > 0]
    begins[i + 1] = False
    after = i + size
    begins[after[after <= last[i]]] = True


def _runs(points: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; begins and ends of runs of one class within a text; the last code point of its text."""
    kind = classes()[points]
    n = len(points)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[texts[:-1][texts[:-1] < n]] = True
    ends = np.ones(n, bool)
    ends[:-1] = begins[1:]
    last = np.repeat(texts[1:] - 1, np.diff(texts))
    return kind, begins, ends, last


def byte_level_pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The matches of public_tokenizers.PATTERN in each text as UTF-8, and how many each text has."""
    if not len(data):
        return pieces(data, np.empty(0, np.int64)), np.zeros(len(offsets) - 1, np.int64)
    points, at, texts = code_points(data, offsets)
    kind, runs, ends, last = _runs(points, texts)
    begins = runs.copy()
    # White space before something else gives up its last code point; a plain blank then joins what follows.
    tail = np.flatnonzero((kind == SPACE) & ends)
    tail = tail[tail < last[tail]]
    begins[tail] = True
    begins[tail[points[tail] == 32] + 1] = False
    _contractions(points, begins, runs & ends & (kind == OTHER), last)
    first = np.flatnonzero(begins)
    return pieces(data, at[first]), np.diff(np.searchsorted(first, texts))


def word_pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Contractions, runs of letters, single numbers and runs of other marks; white space is dropped."""
    if not len(data):
        return pieces(data, np.empty(0, np.int64)), np.zeros(len(offsets) - 1, np.int64)
    points, at, texts = code_points(data, offsets)
    kind, runs, ends, last = _runs(points, texts)
    begins = runs | (kind == NUMBER)
    _contractions(points, begins, runs & ends & (kind == OTHER), last)
    first = np.flatnonzero(begins)
    wanted = kind[first] != SPACE
    values = pieces(data, at[first]).filter(pa.array(wanted))
    return values, np.diff(np.searchsorted(first[wanted], texts))


@lru_cache(1)
def byte_letters() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters
