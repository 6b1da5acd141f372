"""Prices, market, statistics, keywords and sketches against pandas and plain Python."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bellwether.functions.text import STOP_WORDS
from bellwether.operators import direction, keywords, market, prices, sketch, stats

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    parts = []
    for ticker, days in (("A", 80), ("B", 30), ("C", 12), ("D", 3)):
        close = 100 + rng.normal(size=days).cumsum()
        if ticker == "C":
            close[:] = 7.0
        parts.append(
            pd.DataFrame(
                {
                    "ticker": ticker,
                    "trade_date": [START + timedelta(days=i) for i in range(days)],
                    "open": close,
                    "high": close + 1,
                    "low": close - 1,
                    "close": close,
                    "volume": range(days),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame)


def pandas_features(frame):
    parts = []
    for _, g in frame.groupby("ticker"):
        g = g.sort_values("trade_date").copy()
        g["price_change"] = g["close"].diff()
        g["ma_5"] = g["close"].rolling(5).mean()
        g["ma_10"] = g["close"].rolling(10).mean()
        g["target"] = (g["price_change"].shift(-1) > 0).astype(int)
        parts.append(g.dropna())
    return pd.concat(parts)


def test_price_features(bars, frame):
    want = pandas_features(frame).set_index(["ticker", "trade_date"]).sort_index()
    got = prices.price_features(bars).toPandas().set_index(["ticker", "trade_date"]).sort_index()
    assert list(got.index) == list(want.index)
    for column in ("price_change", "ma_5", "ma_10", "target"):
        np.testing.assert_allclose(got[column].astype(float), want[column].astype(float), atol=1e-9)
    assert got["is_last"].sum() == 3


def test_sequences(spark, bars, frame):
    sentiment = spark.createDataFrame(
        [("A", 0.5)], "company string, normalized_sentiment double"
    )
    scaled = direction.model_rows(bars, sentiment)
    # A ticker's sentiment is constant, so it scales to 0.
    assert scaled.agg(F.max(F.abs("sentiment"))).first()[0] == 0
    table = scaled.toPandas().sort_values(["ticker", "trade_date"])
    assert table.groupby("ticker")["ma_5"].agg(["min", "max"]).loc["A"].tolist() == [0.0, 1.0]
    assert (table[table.ticker == "C"]["ma_5"] == 0).all()
    want = []
    for ticker, g in table.groupby("ticker"):
        values, targets = g["ma_5"].tolist(), g["target"].tolist()
        for i in range(len(g) - 10):
            want.append((ticker, values[i : i + 10], targets[i + 10]))
    got = sorted(
        prices.sequences(scaled).collect(), key=lambda r: (r.ticker, r.trade_date)
    )
    assert [(r.ticker, [s.ma_5 for s in r.steps], r.target) for r in got] == want
    latest = {r.ticker: [s.ma_5 for s in r.steps] for r in prices.latest_sequences(scaled).collect()}
    assert latest == {t: table[table.ticker == t]["ma_5"].tolist()[-10:] for t in ("A", "B")}


def test_quotes_and_averages(bars, frame):
    got = {r.ticker: r for r in prices.latest_quotes(bars).collect()}
    for ticker, g in frame.groupby("ticker"):
        close = g["close"].tolist()
        row = got[ticker]
        assert (row.current_price, row.previous_close) == (close[-1], close[-2])
        assert (row.day_high, row.day_low, row.volume) == (close[-1] + 1, close[-1] - 1, len(g) - 1)
        for days, value in ((20, row.sma_20), (50, row.sma_50)):
            if len(close) < days:
                assert value is None
            else:
                assert value == pytest.approx(np.mean(close[-days:]))
    averages = {r.ticker: r.sma_20 for r in prices.latest_averages(bars).collect()}
    assert averages == {t: got[t].sma_20 for t in got}


def test_price_falls_back_to_previous_close(spark):
    df = spark.createDataFrame(
        [("A", START, 1.0, 1.0, 1.0, 5.0, 1), ("A", START + timedelta(1), 1.0, 2.0, 1.0, None, 1)],
        "ticker string, trade_date timestamp, open double, high double, low double, close double, volume bigint",
    )
    row = prices.latest_quotes(df).first()
    assert row.current_price == 5.0 and row.previous_close == 5.0 and row.day_high == 2.0


def series(spark, values):
    return spark.createDataFrame(
        [(START + timedelta(days=i), float(v)) for i, v in enumerate(values)],
        "trade_date timestamp, close double",
    )


def plain_mood(vix, index):
    if len(vix) < 2 or len(index) < 20:
        return 0.0
    vix, index = pd.Series(vix, dtype=float), pd.Series(index, dtype=float)
    std = vix.std(ddof=0)
    fear = 0.0 if std == 0 else -np.tanh((vix.iloc[-1] - vix.mean()) / std)
    short = index.iloc[-5:].pct_change().mean() * 100
    medium = index.iloc[-20:].pct_change().mean() * 100
    return 0.4 * fear + 0.4 * np.tanh(short / 5) + 0.2 * np.tanh(medium / 10)


@pytest.mark.parametrize("vix_days, index_days", [(30, 40), (2, 20), (1, 20), (30, 19)])
def test_market_mood(spark, vix_days, index_days):
    rng = np.random.default_rng(vix_days)
    vix = 20 + rng.normal(size=vix_days)
    index = 4000 * np.exp(np.cumsum(rng.normal(size=index_days) / 50))
    got = market.market_mood(series(spark, index), series(spark, vix)).first()[0]
    assert got == pytest.approx(plain_mood(vix, index), abs=1e-12)
    assert -1 <= got <= 1


def test_market_mood_of_constant_volatility(spark):
    index = [100 + i for i in range(25)]
    got = market.market_mood(series(spark, index), series(spark, [20] * 5)).first()[0]
    assert got == pytest.approx(plain_mood([20] * 5, index), abs=1e-12)


def test_market_indicators(spark):
    rng = np.random.default_rng(1)
    vix, index = 20 + rng.normal(size=50), 4000 + rng.normal(size=50).cumsum()
    row = market.market_indicators(
        market.recent_days(series(spark, index), 30), market.recent_days(series(spark, vix), 30)
    ).first()
    vix, index = pd.Series(vix[-31:]), pd.Series(index[-31:])
    assert row.vix_current == pytest.approx(vix.iloc[-1])
    assert row.vix_avg == pytest.approx(vix.mean())
    assert row.vix_std == pytest.approx(vix.std(ddof=0))
    assert row.index_return == pytest.approx((index.iloc[-1] / index.iloc[0] - 1) * 100)
    spread = index.pct_change().dropna().std(ddof=0) * math.sqrt(252)
    assert row.index_volatility == pytest.approx(spread)


def test_direction_learns_a_plain_rule(spark):
    # The close swings with a period of 8 days, so ten days tell the next move.
    values = [
        (f"T{t}", START + timedelta(days=i), 100 + 5 * math.sin((i + t) * math.pi / 4))
        for t in range(4)
        for i in range(150)
    ]
    bars = spark.createDataFrame(values, "ticker string, trade_date timestamp, close double")
    sentiment = spark.createDataFrame([], "company string, normalized_sentiment double")
    row = direction.direction_accuracy(bars, sentiment).first()
    assert row.samples > 50 and row.accuracy > 0.9
    predicted = direction.predict_direction(bars, sentiment).collect()
    assert len(predicted) == 4 and {r.ml_prediction for r in predicted} <= {"up", "down"}
    short = bars.filter("trade_date < '2024-01-10'")
    assert direction.predict_direction(short, sentiment).isEmpty()
    assert direction.direction_accuracy(short, sentiment).isEmpty()


def test_split_is_repeatable_and_leaves_the_last_day_out(spark, bars):
    rows = prices.sequences(
        direction.model_rows(bars, spark.createDataFrame([], "company string, normalized_sentiment double"))
    )
    train, test = direction.split_samples(rows)
    assert train.count() + test.count() == rows.count() - 2
    assert train.join(test, ["ticker", "trade_date"]).isEmpty()


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [3.0] * 50 + [1.0],
        [random.Random(2).gauss(0, 1) for _ in range(1001)],
        [round(random.Random(i).random(), 2) for i in range(400)] + [1e6],
        [-1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0],
        [random.Random(7).random() for _ in range(3000)] + [1e12, -1e12],
        [10.0 ** random.Random(i).uniform(-30, 30) for i in range(500)],
    ],
)
def test_summary_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = stats.summary(df, "v").first()
    want = pd.Series(values).describe()
    assert row["count"] == want["count"] and row["min"] == want["min"] and row["max"] == want["max"]
    assert row["mean"] == pytest.approx(want["mean"])
    for name, share in (("q25", "25%"), ("q50", "50%"), ("q75", "75%")):
        assert row[name] == pytest.approx(want[share], abs=1e-12)
    if len(values) > 1:
        assert row["std"] == pytest.approx(want["std"])


def test_value_counts(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("c",), (None,)], "s string")
    assert [tuple(r) for r in stats.value_counts(df, "s", 2).collect()] == [("a", 2), ("b", 1)]


TEXTS = [
    "Apple apple APPLE growth! that this with",
    "Gründe growth_rate 2024 株式市場 abc growth",
    None,
    "apple growth news",
]


def test_top_keywords(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "headline string")
    got = [tuple(r) for r in keywords.top_keywords(df).collect()]
    assert got == [
        ("apple", 4),
        ("growth", 3),
        ("2024", 1),
        ("growth_rate", 1),
        ("gründe", 1),
        ("news", 1),
        ("株式市場", 1),
    ]
    assert len(STOP_WORDS) == 181
    assert [r.keyword for r in keywords.top_keywords(df, limit=1).collect()] == ["apple"]


def test_decayed_keywords_use_white_space_tokens(spark):
    now = START
    df = spark.createDataFrame(
        [
            ("apple growth", "news", now),
            ("apple, growth", "news", now - timedelta(hours=10)),
            (None, "growth", None),
        ],
        "headline string, source string, timestamp timestamp",
    )
    wanted = spark.createDataFrame([("apple",), ("growth",)], "keyword string")
    got = {r.keyword: r.weight for r in keywords.decayed_keywords(df, wanted).collect()}
    assert got == {
        "apple": pytest.approx(1.0),
        "growth": pytest.approx(1 + math.exp(-0.36)),
    }


def test_sketch_never_estimates_too_low(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.8)) % 3000}" for _ in range(20000)]
    exact = Counter(words)
    feed = spark.createDataFrame([(w,) for w in words], "keyword string")
    keys = spark.createDataFrame([(w,) for w in exact] + [("absent",)], "keyword string")
    for size in (sketch.WIDE, sketch.NARROW):
        built = sketch.build_sketch(feed, **size)
        assert built.count() <= size["width"] * size["depth"]
        assert built.filter("depth = 0").agg(F.sum("n")).first()[0] == len(words)
        got = {r.keyword: r["count"] for r in sketch.estimate(built, keys, **size).collect()}
        assert set(got) == set(exact) | {"absent"}
        assert all(got[w] >= n for w, n in exact.items())
        top = exact.most_common(1)[0]
        assert got[top[0]] <= top[1] + len(words) * 0.05


def test_sketches_merge_and_weigh(spark, rows):
    one = spark.createDataFrame([("a", 2), ("b", 1)], "keyword string, n int")
    two = spark.createDataFrame([("a", 3)], "keyword string, n int")
    merged = sketch.merge_sketches(
        sketch.build_sketch(one, amount=F.col("n")), sketch.build_sketch(two, amount=F.col("n"))
    )
    whole = sketch.build_sketch(one.union(two), amount=F.col("n"))
    assert rows(merged) == rows(whole)
    assert rows(sketch.estimate(whole, one)) == [("a", 5), ("b", 1)]
    assert sketch.builtin_sketch(one).first()["sketch"] is not None
