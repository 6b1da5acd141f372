"""Decay, labels, company sentiment and the composite scores, against known values."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bellwether.functions.decay import HOURS_RATE, decay
from bellwether.functions.labels import graded_label_score, market_label
from bellwether.functions.values import to_number, to_timestamp
from bellwether.operators import growth, sentiment

NOW = datetime(2025, 7, 29, 8, 15, 37)

# Published results of one run: company, sentiment score, decayed sentiment,
# prediction, growth score, mentions.
GROWTH_ROWS = [
    ("AAPL", 0.0007292892379443, 0.030833928019539974, "up", 0.552155472193007, 14),
    ("AMD", -0.3328775569524251, -0.7365054870808925, None, -0.4897838549026827, 1),
    ("AMZN", 0.0104930502318396, 0.010096823050395942, None, 0.3009175511164335, 2),
    ("Fiserv", 0.0, 0.0, None, 0.28394365649058745, 1),
    ("GOOGL", 0.0001855476150288, 0.044469325933903174, "up", 0.5592789950807044, 6),
    ("Intuitive Surgical", 0.0, 0.0, None, 0.28394365649058745, 1),
    ("META", -2.78971854313512e-06, -0.025442351554187954, None, 0.26955947255297347, 1),
    ("MSFT", 0.0012162626439521, 0.04777894321499818, "up", 0.5622564530479078, 39),
    ("Microsoft", 0.2218553627339836, 0.39794982685969993, None, 0.7470960333762822, 2),
    ("NVDA", 0.0, 0.0, None, 0.28394365649058745, 1),
    ("PepsiCo", 0.0446679541916039, 0.40308735353738306, None, 0.5597485211452004, 1),
    ("TSLA", -0.5232107344504046, -0.8353114093843885, None, -0.75, 1),
]
MARKET = -0.05525358728362906

# Published (age in hours, weight) pairs at 1e-5 per second.
WEIGHTS = [
    (196.26361111, 8.54076320e-04),
    (92.49694444, 3.57970425e-02),
    (574.07722222, 1.05811163e-09),
    (319.2375, 1.02058446e-05),
    (14.26027778, 5.98475315e-01),
    (19.84361111, 4.89500400e-01),
    (429.57111111, 1.92232550e-07),
]


def at(hours):
    return NOW - timedelta(hours=hours)


def test_growth_score_matches_published_rows(spark):
    signals = spark.createDataFrame(
        [(c, s, d, n) for c, s, d, _, _, n in GROWTH_ROWS],
        "company string, normalized_sentiment double, time_decayed_sentiment double, "
        "total_mentions bigint",
    )
    predictions = spark.createDataFrame(
        [(r[0], r[3]) for r in GROWTH_ROWS if r[3]], "company string, ml_prediction string"
    )
    got = {r.company: r for r in growth.growth_score(signals, predictions).collect()}
    assert len(got) == len(GROWTH_ROWS)
    for company, _, _, _, score, mentions in GROWTH_ROWS:
        assert got[company].growth_score == pytest.approx(score, abs=1e-12)
        assert got[company].total_mentions == mentions
        assert got[company].market_sentiment == pytest.approx(MARKET, abs=1e-12)
        assert -1 <= got[company].growth_score <= 1
    assert got["AMD"].ml_prediction == "neutral"


def test_growth_score_of_constant_columns_is_the_direction_share(spark):
    signals = spark.createDataFrame(
        [("A", 0.5, None, None), ("B", 0.5, None, None)],
        "company string, normalized_sentiment double, time_decayed_sentiment double, "
        "total_mentions bigint",
    )
    predictions = spark.createDataFrame(
        [("A", "down")], "company string, ml_prediction string"
    )
    got = {r.company: r for r in growth.growth_score(signals, predictions).collect()}
    assert got["A"].growth_score == pytest.approx(-0.25)
    assert got["B"].growth_score == 0
    assert got["B"].total_mentions == 0 and got["B"].time_decayed_sentiment == 0


def test_decay_weights_match_published_pairs(spark):
    df = spark.createDataFrame([(at(h), w) for h, w in WEIGHTS], "t timestamp, w double")
    for row in df.select("w", decay(F.col("t"), F.lit(NOW)).alias("d")).collect():
        assert row.d == pytest.approx(row.w, rel=1e-5)


def test_decay_of_missing_time_is_zero_and_falls_with_age(spark):
    df = spark.createDataFrame([(None,), (at(1),), (at(5),), (NOW,)], "t timestamp")
    got = [
        r.d
        for r in df.select(decay(F.col("t"), F.lit(NOW), HOURS_RATE, "hours").alias("d")).collect()
    ]
    assert got[0] == 0
    assert got[3] == 1 > got[1] > got[2]
    assert got[2] == pytest.approx(math.exp(-0.05))


MENTIONS = "company string, headline string, sentiment string, confidence double, timestamp timestamp"


def mention_rows(spark):
    return spark.createDataFrame(
        [
            ("A", "a1", "positive", 0.8, at(0)),
            ("A", "a2", "negative", 0.5, at(10)),
            ("A", None, "positive", 1.0, at(20)),
            ("A", "a4", "odd label", 1.0, None),
            ("B", "b1", "neutral", 0.9, None),
            ("", "x", "positive", 0.9, at(0)),
            (None, "y", "positive", 0.9, at(0)),
        ],
        MENTIONS,
    )


def test_company_sentiment_counts_headlines_and_skips_missing_companies(spark):
    got = {
        r.company: r
        for r in sentiment.company_sentiment(
            sentiment.weigh_mentions(mention_rows(spark), NOW)
        ).collect()
    }
    assert set(got) == {"A", "B"}
    total = 0.8 - 0.5 * math.exp(-0.36) + math.exp(-0.72)
    assert got["A"].weighted_sentiment_sum == pytest.approx(total)
    assert got["A"].article_count == 3
    assert got["A"].normalized_sentiment == pytest.approx(total / 3)
    assert got["B"].normalized_sentiment == 0


def test_company_without_headline_has_no_ratio(spark):
    df = spark.createDataFrame([("A", None, "positive", 1.0, NOW)], MENTIONS)
    row = sentiment.company_sentiment(sentiment.weigh_mentions(df)).first()
    assert row.article_count == 0 and row.normalized_sentiment is None


def test_one_pass_signals_equal_the_joined_tables(spark, rows):
    df = mention_rows(spark)
    weighted = sentiment.weigh_mentions(df, NOW)
    joined = growth.join_signals(
        sentiment.company_sentiment(weighted), sentiment.decayed_sentiment(weighted, NOW)
    )
    assert rows(sentiment.company_signals(df, NOW).select(*joined.columns)) == rows(joined)
    assert dict((r.company, r.total_mentions) for r in joined.collect()) == {"A": 3, "B": None}


def test_growth_100_uses_finite_scores_only(spark):
    df = spark.createDataFrame(
        [
            ("A", 1.0, at(0)),
            ("A", float("inf"), at(0)),
            ("A", float("nan"), at(0)),
            ("A", None, at(0)),
            ("A", -0.5, at(10)),
            ("A", 0.3, None),
            ("B", float("-inf"), at(0)),
        ],
        "company string, sentiment_score double, timestamp timestamp",
    )
    got = growth.growth_score_100(df, market=0.1).collect()
    assert [r.company for r in got] == ["A"]
    mean = (1.0 - 0.5 * math.exp(-0.36)) / 2 * 1.1
    assert got[0].avg_sentiment == pytest.approx(mean)
    assert got[0].growth_score == pytest.approx(50 + 50 * mean)
    assert got[0].sentiment_count == 3
    assert got[0].last_updated == "2025-07-29 08:15:37 UTC"


# Published: average and score of three companies.
@pytest.mark.parametrize(
    "average, score",
    [
        (0.017642340705059, 50.88211703525295),
        (0.0168761904117336, 50.84380952058668),
        (0.0161186641212163, 50.805933206060814),
    ],
)
def test_growth_100_scaling(spark, average, score):
    df = spark.createDataFrame(
        [("A", average, NOW)], "company string, sentiment_score double, timestamp timestamp"
    )
    assert growth.growth_score_100(df).first().growth_score == pytest.approx(score, abs=1e-11)


def test_fused_scores_match_published_rows(spark):
    table = spark.createDataFrame(
        [
            ("GOOGL", 1.948964012973078, 100, 0.0194896401297307),
            ("MSFT", 1.869892294966267, 100, 0.0186989229496626),
            ("AAPL", 1.583470077321213, 100, 0.0158347007732121),
            ("NONE", 0.0, 1, 0.0),
        ],
        "company string, weighted_sentiment_sum double, article_count bigint, "
        "normalized_sentiment double",
    )
    predictions = spark.createDataFrame(
        [("AAPL", "up"), ("GOOGL", "up"), ("MSFT", "up")], "company string, ml_prediction string"
    )
    got = growth.fuse_scores(table, predictions).collect()
    assert [r.company for r in got] == ["GOOGL", "MSFT", "AAPL", "NONE"]
    assert [r.final_score for r in got] == pytest.approx(
        [1.0194896401297306, 1.0186989229496626, 1.015834700773212, -1.0]
    )


def test_label_maps(spark, rows):
    df = spark.createDataFrame(
        [("Very_Positive",), ("slightly_negative",), ("odd",), (None,)], "s string"
    )
    got = [r.v for r in df.select(graded_label_score(F.col("s")).alias("v")).collect()]
    assert got == [1.0, -0.5, 0.0, 0.0]
    values = spark.createDataFrame([(0.11,), (0.1,), (-0.1,), (-0.2,)], "v double")
    assert [r.l for r in values.select(market_label(F.col("v")).alias("l")).collect()] == [
        "Positive",
        "Neutral",
        "Neutral",
        "Negative",
    ]


def test_bad_numbers_and_times(spark):
    df = spark.createDataFrame([("1.5", "2024-01-02T03:04:05Z"), ("n/a", "soon"), (None, None)], "n string, t string")
    got = df.select(to_number(F.col("n")).alias("n"), to_timestamp(F.col("t")).alias("t")).collect()
    assert [r.n for r in got] == [1.5, 0.0, 0.0]
    assert got[0].t == datetime(2024, 1, 2, 3, 4, 5) and got[1].t is None


def test_label_counts_and_sector_mean(spark, rows):
    counts = sentiment.label_counts(mention_rows(spark))
    assert rows(counts.select("company", "negative", "neutral", "positive")) == [
        ("A", 1, 0, 2),
        ("B", 0, 1, 0),
    ]
    scores = spark.createDataFrame(
        [("A", 1.0), ("B", 0.0), ("C", 9.0)], "company string, normalized_sentiment double"
    )
    sectors = spark.createDataFrame([("A", "x"), ("B", "x")], "company string, sector string")
    assert rows(sentiment.sector_sentiment(scores, sectors)) == [("x", 0.5)]


def test_update_keeps_rows_and_unmatched_values(spark, rows):
    held = spark.createDataFrame(
        [("A", "up"), ("B", "down"), ("C", None)], "company string, ml_prediction string"
    )
    fresh = spark.createDataFrame(
        [("A", "down"), ("B", None), ("D", "up")], "company string, ml_prediction string"
    )
    assert rows(growth.update_column(held, fresh)) == [
        ("A", "down"),
        ("B", "down"),
        ("C", None),
    ]
    assert rows(growth.update_column(held.select("company"), fresh)) == [
        ("A", "down"),
        ("B", None),
        ("C", None),
    ]


def test_top_and_bottom_ties_by_name(spark, rows):
    df = spark.createDataFrame(
        [("A", 1.0), ("B", 1.0), ("C", 1.0), ("D", 0.0)], "company string, growth_score double"
    )
    assert rows(growth.top_and_bottom(df), "side", "company") == [
        ("bottom", "C"),
        ("bottom", "D"),
        ("top", "A"),
        ("top", "B"),
    ]


def test_blank_text_is_neutral_without_confidence(spark):
    df = spark.createDataFrame(
        [(1, " ", None), (2, None, None), (3, "profit up", "big loss loss"), (4, "growth", "x")],
        "id int, headline string, text string",
    )
    scorer = sentiment.lexicon_scorer({"profit": 1.4, "loss": -1.5, "growth": 1.5})
    got = {r.id: (r.sentiment, r.confidence) for r in sentiment.classify(df, scorer).collect()}
    assert got[1] == got[2] == ("neutral", 0.0)
    assert got[3][0] == "negative" and got[3][1] == pytest.approx(1.6 / 2.6)
    assert got[4] == ("positive", pytest.approx(0.6))


def test_series_arrays_are_parallel_and_sorted(spark):
    df = spark.createDataFrame(
        [("A", at(0), 1.0), ("A", at(1), 0.0), ("A", at(48), 0.5), ("B", at(0), 0.1)],
        "company string, timestamp timestamp, sentiment_score double",
    )
    got = sentiment.company_series(sentiment.daily_sentiment(df), " A ,none").collect()
    assert [r.name for r in got] == ["A"]
    assert [str(x) for x in got[0].dates] == ["2025-07-27", "2025-07-29"]
    assert got[0].sentiment_scores == [0.5, 0.5]


def test_weights_that_cancel_are_neutral(spark):
    weights = {"a": 0.1, "b": 0.2, "c": -0.3}
    df = spark.createDataFrame([("a b c", "")], "headline string, text string")
    row = sentiment.classify(df, sentiment.lexicon_scorer(weights)).first()
    assert (row.sentiment, row.confidence) == ("neutral", 0.0)


def test_model_scorer(spark):
    def load():
        return lambda texts: [("positive" if "up" in t else "negative", len(t) / 10) for t in texts]

    df = spark.createDataFrame(
        [(1, "up", "x"), (2, "low", None), (3, None, None)], "id int, headline string, text string"
    )
    scored = sentiment.classify(df, sentiment.model_scorer(load))
    got = {r.id: (r.sentiment, r.confidence) for r in scored.collect()}
    assert got == {1: ("positive", 0.4), 2: ("negative", 0.3), 3: ("neutral", 0.0)}


def test_a_company_with_a_third_of_all_rows(spark):
    from bellwether.operators import mentions

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(30000).select(
            F.col("id"),
            F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), F.col("id") % 97)).alias("company"),
            F.concat(F.lit("h"), F.col("id")).alias("headline"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("timestamp"),
            F.lit("positive").alias("sentiment"),
            F.lit(0.5).alias("confidence"),
        )
        lists = {r.company_key: r.headlines for r in mentions.headline_lists(df, [F.col("id")]).collect()}
        assert len(lists) == 98 and lists["HOT"] == ["h29997", "h29994", "h29991"]
        signals = {r.company: r.article_count for r in sentiment.company_signals(df).collect()}
        assert signals["HOT"] == 10000 and sum(signals.values()) == 30000
        joined = mentions.attach_sentiment(
            df.select("timestamp", "headline", F.lit("t").alias("text")),
            df.select("timestamp", "headline", F.lit("t").alias("text"), "company", "sentiment"),
        )
        assert joined.filter("company = 'HOT'").count() == 10000 and joined.count() == 30000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
