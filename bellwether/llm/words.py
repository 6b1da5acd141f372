"""Words, their numbers and hashed word shingles of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that scatters uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def seed(i: int) -> np.uint64:
    return np.uint64((i + 1) * _GOLDEN & _WORD)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` text bytes, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for first, last in zip(edges, edges[1:], strict=False):
        if last > first:
            yield batch.slice(first, last - first)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word numbers of all texts in order, start of each text and end, distinct words).

    A word is a maximal run without space, tab, line feed, vertical tab, form
    feed or carriage return. A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    real = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(real).as_py():
        seen = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
        starts, flat = seen[starts], flat.filter(real)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary


def hashed(words: pa.Array) -> np.ndarray:
    """A fixed 64-bit hash of every word."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def shingle_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of one text, in order, with repeats.

    Fewer than k words make one shingle of them all; no words make none.
    """
    n = len(word_hash)
    if not n:
        return word_hash[:0]
    size = min(n, k)
    total = np.full(n - size + 1, seed(size), dtype=np.uint64)
    for j in range(size):
        total = total * np.uint64(_GOLDEN | 1) + word_hash[j : n - size + 1 + j]
    return mixed(total)
