"""Keyword frequency and decayed keyword weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.decay import SECONDS_RATE, as_of_column, decay
from bellwether.functions.text import STOP_WORDS, space_tokens, word_tokens

TOP_KEYWORDS = 100
SHOWN = 15
SHORTEST = 4


def distinct_texts(mentions: DataFrame, as_of=None, rate: float = SECONDS_RATE) -> DataFrame:
    """(headline, source, times, weight): each distinct text once, with its mentions' count and decay.

    A text is tokenised once, however often it is mentioned.
    """
    weight = decay(F.col("timestamp"), as_of_column(mentions, as_of), rate)
    return mentions.groupBy("headline", "source").agg(
        F.count("*").alias("times"), F.sum(weight).alias("weight")
    )


def _times(texts: DataFrame) -> Column:
    """How often a text counts: its column times, or once."""
    return F.col("times") if "times" in texts.columns else F.lit(1)


def keyword_rows(texts: DataFrame, column: str = "headline") -> DataFrame:
    """(keyword, times) of every keyword occurrence: long enough and not a stop word."""
    stops = [w for w in STOP_WORDS if len(w) >= SHORTEST]
    return texts.select(
        F.explode(word_tokens(F.col(column))).alias("keyword"), _times(texts).alias("times")
    ).filter((F.length("keyword") >= SHORTEST) & ~F.col("keyword").isin(stops))


def top_keywords(
    texts: DataFrame, column: str = "headline", limit: int = TOP_KEYWORDS
) -> DataFrame:
    """Most frequent keywords with their counts; ties by keyword.

    Counts are combined per map task, so a frequent word sends one row per task. A
    column times says how often a text counts.
    """
    return (
        keyword_rows(texts, column)
        .groupBy("keyword")
        .agg(F.sum("times").cast("bigint").alias("frequency"))
        .orderBy(F.desc("frequency"), "keyword")
        .limit(limit)
    )


def headline_and_source(mentions: DataFrame) -> Column:
    return F.concat_ws(" ", F.col("headline"), F.col("source"))


def keyword_feed(mentions: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, times) of every occurrence of a keyword in headline and source.

    keywords is a top list: its row limit bounds its size, so Spark broadcasts it
    and tokens are filtered where they arise.
    """
    tokens = word_tokens(headline_and_source(mentions))
    return mentions.select(
        F.explode(tokens).alias("keyword"), _times(mentions).alias("times")
    ).join(keywords.select("keyword"), "keyword", "left_semi")


def decayed_keywords(
    mentions: DataFrame,
    keywords: DataFrame,
    as_of=None,
    rate: float = SECONDS_RATE,
    limit: int = SHOWN,
) -> DataFrame:
    """Keywords by the summed decay of the mentions that hold them.

    Tokens are the white-space pieces of headline and source. Texts that already
    carry a weight (see distinct_texts) are taken as they are.
    """
    if "weight" not in mentions.columns:
        mentions = distinct_texts(mentions, as_of, rate)
    tokens = space_tokens(headline_and_source(mentions))
    return (
        mentions.select(F.explode(tokens).alias("keyword"), "weight")
        .join(keywords.select("keyword"), "keyword", "left_semi")
        .groupBy("keyword")
        .agg(F.sum("weight").alias("weight"))
        .orderBy(F.desc("weight"), "keyword")
        .limit(limit)
    )
