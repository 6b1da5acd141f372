"""Sentiment of mentions, companies and sectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.decay import (
    HOURS_RATE,
    SECONDS_RATE,
    as_of_column,
    decay,
)
from bellwether.functions.labels import signed_confidence
from bellwether.functions.text import join_headline_text, word_tokens
from bellwether.functions.values import present

LABELS = ["negative", "neutral", "positive"]


def weigh_mentions(mentions: DataFrame, as_of=None, rate: float = SECONDS_RATE) -> DataFrame:
    """Add sentiment_score, time_decay_weight and weighted_sentiment."""
    confidence = F.col("confidence") if "confidence" in mentions.columns else None
    moment = as_of_column(mentions, as_of)
    scored = mentions.withColumns(
        {
            "sentiment_score": signed_confidence(F.col("sentiment"), confidence),
            "time_decay_weight": decay(F.col("timestamp"), moment, rate),
        }
    )
    return scored.withColumn(
        "weighted_sentiment", F.col("sentiment_score") * F.col("time_decay_weight")
    )


def _weighted_sum(weighted: Column) -> Column:
    return F.coalesce(F.sum(weighted), F.lit(0.0))


def company_sentiment(weighted: DataFrame) -> DataFrame:
    """Sum of weighted sentiment, number of headlines and their ratio per company."""
    return (
        weighted.filter(present(F.col("company")))
        .groupBy("company")
        .agg(
            _weighted_sum(F.col("weighted_sentiment")).alias("weighted_sentiment_sum"),
            F.count("headline").alias("article_count"),
        )
        .withColumn(
            "normalized_sentiment",
            F.try_divide(F.col("weighted_sentiment_sum"), F.col("article_count")),
        )
    )


def company_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions per company, most first."""
    return (
        mentions.filter(present(F.col("company")))
        .groupBy("company")
        .agg(F.count("*").alias("mention_count"))
        .orderBy(F.desc("mention_count"), "company")
    )


def decayed_sentiment(
    mentions: DataFrame, as_of=None, rate: float = HOURS_RATE, unit: str = "hours"
) -> DataFrame:
    """Mean decayed score and number of mentions per company.

    Rows without a timestamp or company do not count.
    """
    moment = as_of_column(mentions, as_of)
    decayed = F.col("sentiment_score") * decay(F.col("timestamp"), moment, rate, unit)
    return (
        mentions.filter(present(F.col("company")) & F.col("timestamp").isNotNull())
        .groupBy("company")
        .agg(
            F.avg(decayed).alias("time_decayed_sentiment"),
            F.count("*").alias("total_mentions"),
        )
    )


def company_signals(mentions: DataFrame, as_of=None) -> DataFrame:
    """company_sentiment and decayed_sentiment from one pass over the mentions.

    total_mentions is NULL for a company without any dated mention, as it would be
    after joining the two tables.
    """
    moment = as_of_column(mentions, as_of)
    confidence = F.col("confidence") if "confidence" in mentions.columns else None
    score = signed_confidence(F.col("sentiment"), confidence)
    dated = F.col("timestamp").isNotNull()
    slow = decay(F.col("timestamp"), moment, HOURS_RATE, "hours")
    quick = decay(F.col("timestamp"), moment, SECONDS_RATE)
    totals = (
        mentions.filter(present(F.col("company")))
        .select(
            "company",
            "headline",
            dated.alias("dated"),
            (score * quick).alias("weighted"),
            F.when(dated, score * slow).alias("decayed"),
        )
        .groupBy("company")
        .agg(
            _weighted_sum(F.col("weighted")).alias("weighted_sentiment_sum"),
            F.count("headline").alias("article_count"),
            F.avg("decayed").alias("time_decayed_sentiment"),
            F.nullif(F.count_if("dated"), F.lit(0)).alias("total_mentions"),
        )
    )
    return totals.withColumn(
        "normalized_sentiment",
        F.try_divide(F.col("weighted_sentiment_sum"), F.col("article_count")),
    )


def label_counts(mentions: DataFrame) -> DataFrame:
    """Mentions of each label per company, absent labels 0."""
    counts = [F.count_if(F.col("sentiment") == x).alias(x) for x in LABELS]
    return (
        mentions.filter(present(F.col("company")) & F.col("sentiment").isNotNull())
        .groupBy("company")
        .agg(*counts)
    )


def sector_sentiment(sentiment: DataFrame, sectors: DataFrame) -> DataFrame:
    """Mean company sentiment per sector, companies without a sector left out."""
    return (
        sentiment.join(sectors.select("company", "sector"), "company")
        .groupBy("sector")
        .agg(F.avg("normalized_sentiment").alias("normalized_sentiment"))
    )


def daily_sentiment(mentions: DataFrame) -> DataFrame:
    """Mean score per company and day, as (date, company_name, sentiment_score)."""
    return (
        mentions.filter(present(F.col("company")) & F.col("timestamp").isNotNull())
        .groupBy(
            F.to_date("timestamp").alias("date"), F.col("company").alias("company_name")
        )
        .agg(F.avg("sentiment_score").alias("sentiment_score"))
    )


def company_series(daily: DataFrame, companies: str | None = None) -> DataFrame:
    """Parallel date and score arrays per company, sorted by date.

    `companies` is a comma-separated list. Input has one row per company and day,
    so an array is as long as the calendar, however often a company is mentioned.
    """
    if companies:
        wanted = [name.strip() for name in companies.split(",")]
        daily = daily.filter(F.col("company_name").isin(wanted))
    points = F.array_sort(F.collect_list(F.struct("date", "sentiment_score")))
    return (
        daily.groupBy(F.col("company_name").alias("name"))
        .agg(points.alias("points"))
        .select(
            "name",
            F.transform("points", lambda p: p["date"]).alias("dates"),
            F.transform("points", lambda p: p["sentiment_score"]).alias(
                "sentiment_scores"
            ),
        )
    )


def market_series(mentions: DataFrame) -> DataFrame:
    """Mean score of all mentions per day, in date order."""
    return (
        mentions.filter(F.col("timestamp").isNotNull())
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(F.avg("sentiment_score").alias("sentiment_score"))
        .orderBy("date")
    )


def keyword_weights(lexicon: dict[str, float] | DataFrame) -> Column:
    """A signed keyword table as a map: a literal, or (keyword, weight) rows read once.

    The latter is a scalar subquery: make it a column before a score uses it.
    """
    if isinstance(lexicon, DataFrame):
        entries = F.sort_array(F.collect_list(F.struct("keyword", "weight")))
        return lexicon.agg(F.map_from_entries(entries)).scalar()
    return F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])


def lexicon_score(text: Column, lexicon: dict[str, float] | Column) -> Column:
    """Sum of the weights of the words of a text, each occurrence counts.

    The lexicon is a short table, a literal or a map column, so words are looked up
    inside the row without exploding or shuffling the text.
    """
    weights = lexicon if isinstance(lexicon, Column) else keyword_weights(lexicon)
    known = F.transform(
        word_tokens(text), lambda w: F.coalesce(F.try_element_at(weights, w), F.lit(0.0))
    )
    total = F.aggregate(known, F.lit(0.0), lambda total, w: total + w)
    # Weights are short decimals: rounding makes weights that cancel exactly 0.
    return F.round(F.coalesce(total, F.lit(0.0)), 9)


def word_sums(words: DataFrame, key: str, weights: DataFrame, word: str, sums: list[str]) -> DataFrame:
    """Number of words of each key (words), and sums of their weights, 0 where none has any.

    words has a row for each word of a key, and one with a null word for a key without any. The
    weight table is joined by its size, the sums start in the task that reads the words.
    """
    met = words.join(weights, word, "left")
    totals = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums]
    return met.groupBy(key).agg(F.count(word).alias("words"), *totals)


def lexicon_scores(texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lexicon_score) of every text by a table (keyword, weight); each occurrence counts."""
    words = texts.select(key, F.explode_outer(word_tokens(F.col(text))).alias("keyword"))
    sums = word_sums(words, key, lexicon.select("keyword", "weight"), "keyword", ["weight"])
    return sums.select(key, F.round("weight", 9).alias("lexicon_score"))


def graded(score: Column) -> tuple[Column, Column]:
    """Label by the sign of a score, and |s| / (1 + |s|) as confidence."""
    label = F.when(score > 0, F.lit("positive")).when(score < 0, F.lit("negative")).otherwise(F.lit("neutral"))
    return label, F.abs(score) / (F.abs(score) + 1)


def lexicon_scorer(lexicon: dict[str, float] | Column) -> Callable[[Column], Column]:
    """Scorer of a text: label by the sign of the score, |s| / (1 + |s|) confidence."""

    def both(score: Column) -> Column:
        label, confidence = graded(score)
        return F.struct(label.alias("sentiment"), confidence.alias("confidence"))

    def scorer(text: Column) -> Column:
        # One-element transform: the score is computed once per row.
        return F.get(F.transform(F.array(lexicon_score(text, lexicon)), both), 0)

    return scorer


def model_scorer(
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
) -> Callable[[Column], Column]:
    """Scorer by a model of (label, confidence) for a batch of texts.

    `load` runs once per Python worker task, then batches stream through Arrow.
    """

    @F.pandas_udf("sentiment string, confidence double")
    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            yield pd.DataFrame(
                model(texts.fillna("").tolist()), columns=["sentiment", "confidence"]
            )

    return scorer


def classify(mentions: DataFrame, scorer: Callable[[Column], Column]) -> DataFrame:
    """Add sentiment and confidence of headline and text.

    scorer maps a text column to a struct<sentiment, confidence>: a column
    expression, or an iterator pandas_udf that loads a model once per worker.
    Blank text is neutral with confidence 0.
    """
    joined = join_headline_text(F.col("headline"), F.col("text"))
    scored = mentions.withColumn("_scored", scorer(joined))
    blank = F.trim(joined) == ""
    return scored.withColumns(
        {
            "sentiment": F.when(blank, F.lit("neutral")).otherwise(
                F.coalesce("_scored.sentiment", F.lit("neutral"))
            ),
            "confidence": F.when(blank, F.lit(0.0)).otherwise(
                F.coalesce("_scored.confidence", F.lit(0.0))
            ),
        }
    ).drop("_scored")
