"""The public tokenizers as piece encoders for single pre-tokens, loaded once in each worker process."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pre-tokens whose ids a worker keeps at most, unless one call brings more.
KEPT_WORDS = 400_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def whole_text_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


@lru_cache(4)
def pretoken_tokenizer(path: str):
    """The same model, for texts that are one normalised pre-token each."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
    return Tokenizer.from_str(json.dumps(spec))


class PretokenEncoder:
    """Ids of distinct pre-tokens; those met before come from a bounded memory, from which the ones met longest ago go first."""

    def __init__(self, path: str):
        self.tokenizer = pretoken_tokenizer(path)
        self.known, self.flat, self.sizes, self.met, self.calls = pa.array([], pa.large_binary()), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def encoded(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all values one after the other, and how many each has, without the memory; in parts, each as one sequence of pre-tokens."""
        words, ids, sizes = values.cast(pa.large_string()).to_pylist(), [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(coded.ids, np.uint32))
            sizes.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def ids(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all values (distinct ones) one after the other, and how many each has."""
        self.calls += 1
        if len(self.known) > KEPT_WORDS:
            lately = np.flatnonzero(self.met > np.median(self.met))
            self.flat = spread(self.flat, self.sizes, lately)
            self.known, self.sizes, self.met = self.known.take(pa.array(lately)), self.sizes[lately], self.met[lately]
        at = pc.index_in(values, value_set=self.known)
        new = values.filter(at.is_null())
        ids, sizes = self.encoded(new)
        places = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        places[places < 0] = np.arange(len(self.known), len(self.known) + len(new))
        self.known, self.flat, self.sizes, self.met = pa.concat_arrays([self.known, new]), np.append(self.flat, ids), np.append(self.sizes, sizes), np.append(self.met, np.zeros(len(new), np.int64))
        self.met[places] = self.calls
        return spread(self.flat, self.sizes, places), self.sizes[places]


@lru_cache(4)
def encoder(path: str) -> PretokenEncoder:
    return PretokenEncoder(path)


def spread(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of flat that the codes name, one after the other."""
    begin = np.cumsum(sizes) - sizes
    n = sizes[codes]
    return flat[np.repeat(begin[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
