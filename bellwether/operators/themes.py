"""Sentiment of themes named by keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.functions.text import space_tokens

LABELS = ("positive", "neutral", "negative")


def theme_sentiment(mentions: DataFrame, theme_keywords: DataFrame) -> DataFrame:
    """Label counts and net score per theme; every matching token counts.

    theme_keywords has (keyword, theme) rows. Mentions have a sentiment, or are
    texts with a count of mentions per label. Labels are counted per distinct headline
    first and per keyword next, so a text is tokenised once and the join sees one
    row per keyword.
    """
    if "sentiment" in mentions.columns:
        mentions = mentions.groupBy("headline").agg(
            *[F.count_if(F.col("sentiment") == label).alias(label) for label in LABELS]
        )
    totals = [F.sum(label).cast("bigint").alias(label) for label in LABELS]
    counts = (
        mentions.select(F.explode(space_tokens(F.col("headline"))).alias("keyword"), *LABELS)
        .join(theme_keywords.select("keyword").distinct(), "keyword", "left_semi")
        .groupBy("keyword")
        .agg(*totals)
        .join(theme_keywords, "keyword")
        .groupBy("theme")
        .agg(*totals)
    )
    everything = F.col("positive") + F.col("neutral") + F.col("negative")
    net = F.try_divide(F.col("positive") - F.col("negative"), everything)
    return counts.withColumn(
        "macro_sentiment_score", F.round(F.coalesce(net, F.lit(0.0)), 3)
    )
