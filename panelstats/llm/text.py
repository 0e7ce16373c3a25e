"""Words and text helpers inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

#: Words kept by a cache at most; beyond it the cache starts anew.
CACHED_WORDS = 1 << 16

_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}


def raw(text: str | None) -> bytes:
    """UTF-8 of a text, nothing for null."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def words(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` in order: bytes split at exactly that white space."""
    return raw(text).split()


def lower_words(text: str | None) -> list[bytes]:
    """The same words with A-Z lower-cased and nothing else."""
    return raw(text).lower().split()


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) & 0x7FFFFFFFFFFFFFFF
        return found

    def of(self, some: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, some), np.int64, len(some)).view(np.uint64)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def pair_hash(first: np.ndarray, second: np.ndarray, kind: int) -> np.ndarray:
    """A hash of two word hashes in order; ``kind`` keeps families of features apart."""
    mixed = (first * _MIX[0] + np.uint64(kind)) ^ (second * _MIX[1])
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[2]
    return mixed ^ (mixed >> np.uint64(32))


def ngram_features(hashes: np.ndarray, bits: int, gaps: Iterable[int]) -> np.ndarray:
    """Buckets of words and of word pairs at the given distances, repeats included."""
    shift = np.uint64(64 - bits)
    parts = [pair_hash(hashes, hashes, 0) >> shift]
    for gap in gaps:
        if len(hashes) > gap:
            parts.append(pair_hash(hashes[:-gap], hashes[gap:], gap) >> shift)
    return np.concatenate(parts).astype(np.int64)


def batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays(
        [
            columns[f.name] if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(columns[f.name], f.type)
            for f in schema
        ],
        schema=schema,
    )
