"""Exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwether.llm import exact_search
from bellwether.llm.exact_search import nearest, products, quantised


def brute(rows, k, is_query):
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v is not None))
    out = []
    for q, a in rows:
        if is_query(q):
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def vectors(seed, n=260, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-90, 90, (5, dim))
    rows = [(int(i), (centres[i % 5] + rng.integers(-9, 9, dim)).tolist()) for i in rng.permutation(n)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(70)]  # equal vectors
    rows += [(2000, [0] * dim), (2010, [5]), (2020, []), (None, [1] * dim), (2030, None), (7, [1] * dim)]
    return rows + rows[:3]


@pytest.mark.parametrize(("pivots", "cell", "block", "chunk"), [(64, 4096, 256, 32), (4, 30, 5, 2)])
def test_against_brute_force(spark, monkeypatch, pivots, cell, block, chunk):
    for name, value in (("CELL_ROWS", cell), ("BLOCK_ROWS", block), ("CHUNK_BLOCKS", chunk)):
        monkeypatch.setattr(exact_search, name, value)
    rows = vectors(pivots)
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, v array<long>, rank int")
    got = nearest(frame.repartition(3), F.col("vec_id") % 10 == 0, 5, pivots)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, lambda i: i % 10 == 0)


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [3, 4])], "vec_id long, v array<long>")
    got = nearest(frame, F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 11), (0, 2, 2, 11)]
    assert nearest(frame, F.col("vec_id") == 9).collect() == []
    assert nearest(frame.limit(0), F.col("vec_id") == 0).collect() == []
    assert nearest(frame.limit(1), F.col("vec_id") == 0).collect() == []


def test_quantised(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.001, 1.0],), ([nan],), ([inf],), ([None, 1.0],), (None,), ([],)]
    got = [r.v for r in spark.createDataFrame(rows, "e array<float>").select(quantised("e").alias("v")).collect()]
    assert got == [[128, -1, 256], None, None, None, None, []]


def test_large_products_are_exact():
    a = np.array([[2**30, 3, -7]]), np.array([[2**31, 5, 11], [1, 1, 1]])
    assert products(*a).tolist() == [[2**61 + 15 - 77, 2**30 - 4]]
