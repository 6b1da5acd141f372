"""Composite scores and rankings of companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.decay import SECONDS_RATE, age_seconds, as_of_column
from bellwether.functions.labels import direction_score, up_or_down_score
from bellwether.functions.values import is_finite, min_max, present, utc_text
from bellwether.schemas import GROWTH
from bellwether.operators.sentiment import company_signals

SENTIMENT_SHARE = 0.40
DECAYED_SHARE = 0.35
DIRECTION_SHARE = 0.25


def _bounds(signals: DataFrame) -> Column:
    """Extremes and market mean over all companies, as one scalar subquery.

    It reads every column of signals, so its plan equals the main one up to the
    shuffle and Spark computes the aggregate once for both.
    """
    decayed = F.coalesce("time_decayed_sentiment", F.lit(0.0))
    return signals.agg(
        F.struct(
            F.min("normalized_sentiment").alias("s_low"),
            F.max("normalized_sentiment").alias("s_high"),
            F.min(decayed).alias("d_low"),
            F.max(decayed).alias("d_high"),
            F.avg("time_decayed_sentiment").alias("market"),
            F.sum("total_mentions").alias("mentions"),
        )
    ).scalar()


def _scaled(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(0.0)).otherwise(
        min_max(value, low, high, floor=-1.0, ceiling=1.0)
    )


def growth_score(signals: DataFrame, predictions: DataFrame, market: Column | None = None):
    """0.40 sentiment + 0.35 decayed sentiment + 0.25 direction per company.

    signals has company, normalized_sentiment, time_decayed_sentiment and
    total_mentions; the first two terms are scaled to [-1, 1] over all companies.
    market defaults to the mean of the companies' decayed means.
    """
    joined = signals.withColumn("b", _bounds(signals)).join(
        predictions.select("company", "ml_prediction"), "company", "left"
    )
    filled = joined.na.fill(
        {"time_decayed_sentiment": 0.0, "total_mentions": 0, "ml_prediction": "neutral"}
    )
    score = (
        SENTIMENT_SHARE
        * _scaled(F.col("normalized_sentiment"), F.col("b.s_low"), F.col("b.s_high"))
        + DECAYED_SHARE
        * _scaled(F.col("time_decayed_sentiment"), F.col("b.d_low"), F.col("b.d_high"))
        + DIRECTION_SHARE * direction_score(F.col("ml_prediction"))
    )
    return filled.select(
        "company",
        F.col("normalized_sentiment").alias("sentiment_score"),
        "time_decayed_sentiment",
        "ml_prediction",
        score.alias("growth_score"),
        (F.col("b.market") if market is None else market).alias("market_sentiment"),
        "total_mentions",
    ).select(*GROWTH.fieldNames())


def join_signals(sentiment: DataFrame, decayed: DataFrame) -> DataFrame:
    """company_sentiment with decayed_sentiment, for tables computed apart."""
    return sentiment.join(decayed, "company", "left").select(
        "company", "normalized_sentiment", "time_decayed_sentiment", "total_mentions"
    )


def growth_from_mentions(mentions: DataFrame, predictions: DataFrame, as_of=None):
    """growth_score of labelled mentions, one aggregation of the mentions."""
    signals = company_signals(mentions, as_of).select(
        "company", "normalized_sentiment", "time_decayed_sentiment", "total_mentions"
    )
    return growth_score(signals, predictions)


def growth_score_100(
    mentions: DataFrame,
    market: Column | float = 0.0,
    rate: float = SECONDS_RATE,
    as_of=None,
) -> DataFrame:
    """50 + 50 * mean(score * decay * (1 + market)) over finite scores per company.

    The reference time is the latest timestamp of all rows. A finite score without a
    timestamp counts in sentiment_count but not in the mean. Companies without a
    finite score are left out.
    """
    market = F.lit(float(market)) if not isinstance(market, Column) else market
    moment = as_of_column(mentions, as_of)
    weight = F.exp(F.lit(-rate) * age_seconds(F.col("timestamp"), F.col("_moment")))
    adjusted = F.col("sentiment_score") * weight * (1 + F.col("_market"))
    return (
        mentions.filter(present(F.col("company")) & is_finite(F.col("sentiment_score")))
        .withColumns({"_moment": moment, "_market": market})
        .groupBy("company")
        .agg(
            F.avg(adjusted).alias("avg_sentiment"),
            F.count("*").alias("sentiment_count"),
            F.max("_moment").alias("_moment"),
        )
        .select(
            "company",
            (50 + F.col("avg_sentiment") * 50).alias("growth_score"),
            "avg_sentiment",
            "sentiment_count",
            utc_text(F.col("_moment")).alias("last_updated"),
        )
    )


def fuse_scores(sentiment: DataFrame, predictions: DataFrame) -> DataFrame:
    """Normalised sentiment plus 1 for up, minus 1 otherwise; best first."""
    fused = sentiment.join(predictions.select("company", "ml_prediction"), "company", "left")
    return (
        fused.withColumn("ml_prediction_score", up_or_down_score(F.col("ml_prediction")))
        .withColumn(
            "final_score", F.col("normalized_sentiment") + F.col("ml_prediction_score")
        )
        .orderBy(F.desc("final_score"), "company")
    )


def top(df: DataFrame, score: str, limit: int, key: str = "company") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), key).limit(limit)


def top_and_bottom(growth: DataFrame, limit: int = 2, score: str = "growth_score"):
    """Best and worst companies, as (side, company, score)."""
    best = top(growth, score, limit).select(F.lit("top").alias("side"), "company", score)
    worst = (
        growth.orderBy(F.asc_nulls_first(score), F.desc("company"))
        .limit(limit)
        .select(F.lit("bottom").alias("side"), "company", score)
    )
    return best.union(worst)


def update_column(
    df: DataFrame, changes: DataFrame, column: str = "ml_prediction", key: str = "company"
) -> DataFrame:
    """Take non-null values of `changes`, keep the rest; a new column is just joined."""
    fresh = changes.select(key, F.col(column).alias("_fresh"))
    joined = df.join(fresh, key, "left")
    if column in df.columns:
        kept = [c for c in df.columns]
        return joined.withColumn(column, F.coalesce("_fresh", column)).select(*kept)
    return joined.withColumnRenamed("_fresh", column)


def known_companies(*tables: DataFrame) -> DataFrame:
    """Distinct company names of several tables."""
    names = None
    for table in tables:
        part = table.select("company").filter(present(F.col("company")))
        names = part if names is None else names.union(part)
    return names.distinct()


def companies_in_both(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.select("company").intersect(other.select("company"))


def company_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Companies of one table only, as (side, company)."""
    a, b = one.select("company"), other.select("company")
    return (
        a.subtract(b)
        .select(F.lit("first only").alias("side"), "company")
        .union(b.subtract(a).select(F.lit("second only").alias("side"), "company"))
    )
