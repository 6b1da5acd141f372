"""Suffix arrays and passage removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bellwether.llm import passages
from bellwether.llm.passages import repeated_passages
from bellwether.llm.suffixes import common_prefixes, repeated_windows, suffix_array


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(40):
        data = rng.integers(97, 99, rng.integers(1, 300)).astype(np.uint8)
        if trial % 3 == 0:
            data = np.tile(data[: max(1, len(data) // 5)], 6)
        text = data.tobytes()
        order = suffix_array(data)
        assert list(order) == sorted(range(len(data)), key=lambda i: text[i:])
        for depth in (5, 30):
            shared = common_prefixes(data, order, depth, lanes=7)
            for a, b in zip(order, order[1:]):
                n = 0
                while n < depth and max(a, b) + n < len(data) and text[a + n] == text[b + n]:
                    n += 1
                assert shared[b] == n
            starts = np.arange(max(0, len(data) - depth + 1))
            times = Counter(text[i : i + depth] for i in starts)
            twice, _ = repeated_windows(data, starts, depth)
            assert twice.tolist() == [times[text[i : i + depth]] > 1 for i in starts]


def brute(rows):
    times, length = Counter(), passages.LENGTH
    for _, text in rows:
        data = (text or "").encode()
        times.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if times[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(4)

    def prose(n):
        return "".join(rng.choice("abcdefghij é ") for _ in range(n))

    shared = [prose(n) for n in (150, 199, 205, 420)]
    rows = [None, "", "short", "ab" * 300, "é" * 101, prose(3000), prose(199)]
    rows += [prose(200)] * 2
    for i in range(40):
        piece = shared[i % 4]
        cut = rng.randrange(3)
        rows.append(prose(rng.randrange(400)) + piece[cut:] + prose(rng.randrange(400)))
    near = prose(2500)
    for _ in range(15):
        at = rng.randrange(2000)
        rows.append(near[:at] + "X" * rng.randrange(1, 4) + near[at:])
    return [(i, t) for i, t in enumerate(rows)] + [(None, shared[3]), (7, rows[7])]


@pytest.mark.parametrize(("shard", "group", "merged", "piece"), [(2 << 20, 1 << 20, 1 << 20, 1 << 20), (3000, 700, 200, 900)])
def test_against_brute_force(spark, monkeypatch, shard, group, merged, piece):
    for name, value in (("SHARD", shard), ("GROUP", group), ("MERGED", merged)):
        monkeypatch.setattr(passages, name, value)
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = repeated_passages(docs.repartition(3)).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_long_text_in_pieces():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    whole = list(passages._pieces([data]))
    assert len(whole) == 1
    starts = set()
    small, passages.PIECE = passages.PIECE, 900
    try:
        for parts, owners, bases in passages._pieces([data, data[:100], data[:1000]]):
            text, lo, count, _, _ = passages.segments(np.concatenate(parts), np.cumsum([len(p) for p in parts]))
            for t, a, n in zip(text, lo, count):
                for s in range(a + bases[t], a + bases[t] + n):
                    assert (owners[t], s) not in starts
                    starts.add((owners[t], s))
    finally:
        passages.PIECE = small
    assert starts == {(0, s) for s in range(4801)} | {(2, s) for s in range(801)}


def test_empty(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
