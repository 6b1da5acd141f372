"""Signals from daily sums against a full run, and windows by cells against pandas."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bellwether.operators import increments, market, sentiment

AS_OF = datetime(2024, 3, 9, 15, 0)


def mentions(spark, days, seed=1):
    rng = random.Random(seed)
    rows = []
    for day in days:
        for _ in range(rng.randrange(1, 30)):
            at = datetime(2024, 3, 1) + timedelta(days=day, seconds=rng.randrange(86_400))
            rows.append((at, rng.choice(["A", "B", "", None]), rng.choice(["h", None]), rng.choice(["positive", "negative", "neutral", None]), rng.random()))
    rows += [(None, "A", "h", "positive", 0.5), (None, "U", "h", "negative", 0.5)]
    return spark.createDataFrame(rows, "timestamp timestamp, company string, headline string, sentiment string, confidence double")


def found(df):
    return {r.company: {k: v for k, v in r.asDict().items() if k != "company"} for r in df.collect()}


def test_added_days_equal_a_full_run(spark, tmp_path):
    path = str(tmp_path / "days")
    first, late = mentions(spark, range(5)), mentions(spark, [5, 6], seed=2).filter("timestamp is not null")
    increments.write_days(first, path)
    before = {f.split("/")[-2]: f for f in spark.read.parquet(path).inputFiles()}
    increments.write_days(late, path)
    after = {f.split("/")[-2]: f for f in spark.read.parquet(path).inputFiles()}
    # The earlier days' files are as they were.
    assert len(after) == len(before) + 2 and all(after[d] == f for d, f in before.items())
    want = found(sentiment.company_signals(first.unionByName(late), AS_OF))
    got = found(increments.signals(spark, path, F.lit(AS_OF)))
    assert set(got) == set(want) == {"A", "B", "U"}
    for company, row in want.items():
        for name, value in row.items():
            assert got[company][name] == (None if value is None else pytest.approx(value)), (company, name)


def test_a_day_written_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = mentions(spark, range(3))
    increments.write_days(rows, path)
    once = found(increments.signals(spark, path, F.lit(AS_OF)))
    increments.write_days(rows.filter(F.to_date("timestamp") == "2024-03-02"), path)
    again = found(increments.signals(spark, path, F.lit(AS_OF)))
    assert {c: r["article_count"] for c, r in once.items()} == {c: r["article_count"] for c, r in again.items()}


def test_returns_by_cells(spark):
    rng = np.random.default_rng(2)
    days = np.sort(rng.choice(900, 200, replace=False))
    closes = 100 * np.exp(np.cumsum(rng.normal(size=200) / 30))
    rows = [(datetime(2020, 1, 1) + timedelta(days=int(d), hours=9 + k), float(c) + 9 * (k < 1)) for d, c in zip(days, closes) for k in range(2)]
    series = spark.createDataFrame([*rows, (None, 1.0), (datetime(2020, 1, 1), None)], "trade_date timestamp, close double")
    got = market.daily_returns(series.repartition(4)).orderBy("trade_date").toPandas()
    want = pd.Series(closes)
    assert np.allclose(got.close, want) and np.allclose(got.change[1:], want.pct_change()[1:]) and np.isnan(got.change[0])
    assert np.allclose(got.total_change, want / want[0] - 1)
    assert market.daily_returns(series.limit(0)).collect() == []
