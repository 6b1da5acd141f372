"""Periodic runs against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bellwether.llm import periodic_runs as module
from bellwether.llm.periodic_runs import lag_scan, periodic_runs, run_report, runs_of, surviving, with_repeats
from bellwether.llm.queries import QUERIES


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_runs(words):
    """All runs, straight from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, left)]
    return (doc_id, len(runs), *best, *digests)


def texts(rng):
    """Texts with runs of many periods, side by side, nested and overlapping."""
    out = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 6)):
            p, size = rng.choice((1, 2, 3, 5, 8, 13, 30)), rng.randrange(1, 90)
            block = [rng.choice("abcde") for _ in range(p)]
            words += [block[i % p] for i in range(size)]
            words += [rng.choice("abcdefghij") for _ in range(rng.choice((0, 0, 1, 7)))]
        out.append(words)
    return out


def test_runs_equal_brute_force():
    rng = random.Random(5)
    cases = texts(rng) + [[], ["x"], ["x"] * 23, ["x"] * 24, list("ab") * 11 + ["a"], list("abcdefgh") * 3]
    names = {w: i for i, w in enumerate(sorted({w for c in cases for w in c}))}
    flat = np.array([names[w] for c in cases for w in c])
    starts = np.concatenate(([0], np.cumsum([len(c) for c in cases])))
    got = dict(runs_of(flat, starts))
    for i, words in enumerate(cases):
        assert got.get(i, []) == plain_runs(words), words


def test_splitting_leaves_only_what_can_hold_runs():
    rng = np.random.default_rng(1)
    words = np.concatenate((rng.integers(100, 10**6, 5000), np.tile(np.arange(9), 4), rng.integers(100, 10**6, 5000)))
    assert surviving(words, np.array([0, len(words)])).tolist() == [[5000, 5036]]
    # A boundary between texts splits too.
    assert surviving(np.tile(np.arange(9), 4), np.array([0, 18, 36])).tolist() == []


@pytest.mark.parametrize("period", [1, 2, 70_000])
def test_long_texts_end_soon(period):
    words = np.random.default_rng(2).integers(0, 50, 10)[np.arange(300_000) % 10] if period == 2 else None
    if words is None:
        words = np.tile(np.random.default_rng(3).integers(0, 1000, period), 300_000 // period + 1)[:300_000]
    began = time.process_time()
    runs = lag_scan(words)
    assert time.process_time() - began < 20
    assert len(runs) == 1 and runs[0][:2] == (0, 300_000)


def test_report(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts(rng))]
    rows += [(10**9 + i, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(1, 400)))) for i in range(40)]
    rows += [(None, "a " * 40), (None, None), (7, ""), (7, " \n\t"), (7, "é\x0b" * 50), (7, "x y z\n" * 3000), (7, "x y z\n" * 3000)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, runs string, words int")
    got = [tuple(r) for r in run_report(periodic_runs(with_repeats(docs.repartition(3)))).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t in rows), key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert run_report(periodic_runs(with_repeats(none))).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()]
    assert any(r[1] for r in got)
    short = {i for i, t in docs if len(t or "") < 12_000}
    assert sorted(r for r in got if r[0] in short) == sorted(expected(i, t) for i, t in docs if i in short)
    assert len(got) == len(docs)


def test_workers_hold_a_slice_of_a_batch():
    text = " ".join(f"w{i}" for i in range(50_000))
    ids = list(range(40))
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text": [text] * 39 + [None]})
    most = module.SLICE // len(text) + 1
    for step in (module.repeated, module.scanned):
        parts = list(step(iter([batch])))
        assert max(p.num_rows for p in parts) <= most < len(ids)
        assert [i for p in parts for i in p.column("doc_id").to_pylist()] == ids
