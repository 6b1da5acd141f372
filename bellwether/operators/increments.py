"""Company signals from sums per day, so that a new day adds to a table in place of a new run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.functions.decay import HOURS_RATE, SECONDS_RATE, age_seconds
from bellwether.functions.labels import signed_confidence
from bellwether.functions.values import present

UNDATED = "undated"
PARTIALS = (
    "company string, weighted double, decayed double, dated bigint, scored bigint, headlines bigint, day string"
)


def _day_end(day: Column) -> Column:
    """The first moment after a day; decay within the day counts from it, so no weight grows large."""
    return F.date_add(day, 1).cast("timestamp")


def daily_partials(mentions: DataFrame) -> DataFrame:
    """Sums per company and day of the mentions, decayed to the end of their day.

    exp(-r (T - t)) = exp(-r (T - e)) exp(-r (e - t)), so the sums of a day with end e serve for every
    later moment T. Mentions without a timestamp weigh nothing and are the day UNDATED.
    """
    confidence = F.col("confidence") if "confidence" in mentions.columns else None
    score = signed_confidence(F.col("sentiment"), confidence)
    dated = F.col("timestamp").isNotNull()
    age = age_seconds(F.col("timestamp"), _day_end(F.to_date("timestamp")))

    def kept(rate: float, unit: float) -> Column:
        return F.coalesce(F.sum(score * F.exp(F.lit(-rate / unit) * age)), F.lit(0.0))

    return (
        mentions.filter(present(F.col("company")))
        .groupBy("company", F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit(UNDATED)).alias("day"))
        .agg(
            kept(SECONDS_RATE, 1.0).alias("weighted"),
            kept(HOURS_RATE, 3600.0).alias("decayed"),
            F.count_if(dated).alias("dated"),
            F.count_if(dated & score.isNotNull()).alias("scored"),
            F.count("headline").alias("headlines"),
        )
        .select("company", "weighted", "decayed", "dated", "scored", "headlines", "day")
    )


def write_days(mentions: DataFrame, path: str) -> None:
    """Put the days that mentions holds into the table at path, in place of what it has for them.

    mentions must hold whole days. Other days are neither read nor written.
    """
    writer = daily_partials(mentions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def signals(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """The company signals of all days of the table, as a run over all mentions gives them.

    (company, weighted_sentiment_sum, article_count, normalized_sentiment, time_decayed_sentiment, total_mentions)
    """
    days = spark.read.schema(PARTIALS).parquet(path)
    age = age_seconds(_day_end(F.expr("try_cast(day AS date)")), as_of)

    def total(column: str, rate: float, unit: float) -> Column:
        return F.coalesce(F.sum(F.col(column) * F.coalesce(F.exp(F.lit(-rate / unit) * age), F.lit(0.0))), F.lit(0.0))

    sums = days.groupBy("company").agg(
        total("weighted", SECONDS_RATE, 1.0).alias("weighted_sentiment_sum"),
        total("decayed", HOURS_RATE, 3600.0).alias("decayed"),
        F.sum("headlines").alias("article_count"),
        F.sum("dated").alias("dated"),
        F.sum("scored").alias("scored"),
    )
    return sums.select(
        "company",
        "weighted_sentiment_sum",
        "article_count",
        F.try_divide("weighted_sentiment_sum", "article_count").alias("normalized_sentiment"),
        F.try_divide("decayed", F.nullif("scored", F.lit(0))).alias("time_decayed_sentiment"),
        F.nullif("dated", F.lit(0)).alias("total_mentions"),
    )
