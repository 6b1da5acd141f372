"""Suffix arrays and common prefixes of one shard's bytes, in numpy."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # no byte of UTF-8


def packed_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, the first one highest; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    keys = np.zeros(len(data), np.uint64)
    for j in range(8):
        keys |= padded[j : j + len(data)] << np.uint64(8 * (7 - j))
    return keys


def _new_groups(order_keys: np.ndarray) -> np.ndarray:
    first = np.ones(len(order_keys), bool)
    first[1:] = order_keys[1:] != order_keys[:-1]
    return first


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in the order of the bytes from there to the end, by Larsson-Sadakane refinement.

    Sorted by eight bytes first. A group of equal positions is then ordered by the
    rank of the position that far behind, which doubles the compared length; groups of
    one are finished and left alone.
    """
    n = len(data)
    keys = packed_bytes(data)
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(_new_groups(keys[order]))
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    width = 8
    while True:
        open_slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(open_slots):
            break
        where = order[open_slots]
        behind = where + width
        next_rank = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        combined = rank[where] * np.int64(n + 1) + next_rank
        by = np.argsort(combined, kind="stable")
        order[open_slots] = where[by]
        first = np.ones(n, bool)
        old_first = np.zeros(n, bool)
        old_first[heads] = True
        first[open_slots] = _new_groups(combined[by])
        first |= old_first
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, n))
        fresh = np.empty(n, np.int64)
        fresh[order] = np.repeat(heads, sizes)
        rank = fresh
        width *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, lanes: int = 4096) -> np.ndarray:
    """For every position, the length it shares with its predecessor in order, up to depth (Kasai).

    The length falls by at most one from a position to the next, so every position
    starts where its neighbour stopped. Many stretches of the data are walked in step.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    keys = np.concatenate((packed_bytes(data), np.zeros(1, np.uint64)))
    stretch = max(1, -(-n // lanes))
    begins = np.arange(0, n, stretch)
    length = np.zeros(len(begins), np.int64)
    shared = np.zeros(n, np.int64)
    for step in range(stretch):
        at = begins + step
        alive = at < n
        if not alive.all():
            begins, length, at = begins[alive], length[alive], at[alive]
        other = before[at]
        length = np.maximum(length - 1, 0)
        length[other < 0] = 0
        going = np.flatnonzero((other >= 0) & (length < depth))
        while len(going):
            left, right, have = at[going], other[going], length[going]
            x, y = np.minimum(left + have, n), np.minimum(right + have, n)
            differ = keys[x] ^ keys[y]
            same = np.zeros(len(going), np.int64)
            for j in range(8):
                same += differ < np.uint64(1 << (8 * j)) if j else differ == 0
            room = n - np.maximum(left, right) - have
            gain = np.minimum(np.minimum(same, room), depth - have)
            length[going] = have + gain
            going = going[(gain == 8) & (length[going] < depth)]
        shared[at] = length
    return shared


def repeated_windows(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the next depth bytes of each start occur at another position, a class number for equal ones)."""
    order = suffix_array(data)
    shared = common_prefixes(data, order, depth)
    long = shared >= depth
    twice = long.copy()
    in_order = long[order]
    twice[order[:-1][in_order[1:]]] = True
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(~in_order)
    return twice[starts], number[starts]
