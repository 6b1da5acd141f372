"""Merging, filtering and listing mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions.values import blank_to_null, epoch_to_timestamp, present, to_timestamp

MENTION_COLUMNS = ["timestamp", "headline", "text", "source", "url", "company"]

# Column names of the two sources in the mention schema.
NEWS_NAMES = {"title": "headline", "description": "text", "publishedAt": "timestamp"}
POST_NAMES = {"title": "headline", "created_utc": "timestamp"}

SENTIMENT_COLUMNS = ["company", "sentiment", "sentiment_score"]


def _as_mentions(
    df: DataFrame, names: dict[str, str], source: str, columns: list[str], time
) -> DataFrame:
    renamed = df.withColumnsRenamed(names).withColumn("source", F.lit(source))
    shaped = renamed.select(*columns)
    if "timestamp" in columns:
        shaped = shaped.withColumn("timestamp", time(F.col("timestamp")))
    return shaped


def _complete(df: DataFrame) -> DataFrame:
    return blank_to_null(df).dropna(subset=["headline", "text"])


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("timestamp").desc_nulls_last())


def merge_sources(news: DataFrame, posts: DataFrame, ordered: bool = True) -> DataFrame:
    """Bag union of news and posts in the mention schema.

    Newest first; without the order the merge needs no shuffle.
    """
    merged = _as_mentions(
        news, NEWS_NAMES, "news", MENTION_COLUMNS, to_timestamp
    ).unionByName(
        _as_mentions(posts, POST_NAMES, "reddit", MENTION_COLUMNS, epoch_to_timestamp)
    )
    merged = _complete(merged)
    return _newest_first(merged) if ordered else merged


def merge_available(news: DataFrame, posts: DataFrame) -> DataFrame:
    """The same without company, keeping only the columns each source has."""

    def shape(df: DataFrame, names: dict[str, str], source: str, time) -> DataFrame:
        have = {names.get(c, c) for c in df.columns} | {"source"}
        kept = [c for c in MENTION_COLUMNS[:-1] if c in have]
        return _as_mentions(df, names, source, kept, time)

    merged = shape(news, NEWS_NAMES, "news", to_timestamp).unionByName(
        shape(posts, POST_NAMES, "reddit", epoch_to_timestamp), allowMissingColumns=True
    )
    return _complete(merged)


def attach_sentiment(mentions: DataFrame, scored: DataFrame) -> DataFrame:
    """Left join on (timestamp, headline, text); missing timestamps match each other.

    Rows multiply when the scored side repeats a key. Headline and text meet as a digest of two
    parts, 128 bits, so the scored side moves without its texts, and texts are not compared
    letter by letter. A key held by many rows is split by the adaptive skew join.
    """
    extra = [c for c in SENTIMENT_COLUMNS if c in scored.columns]
    texts = ["headline", "text"]
    parts = [F.xxhash64(*texts).alias("d1"), F.xxhash64(F.lit(1), *texts).alias("d2")]
    # A missing headline or text equals nothing.
    whole = F.col("headline").isNotNull() & F.col("text").isNotNull()
    left = mentions.select("*", *[F.when(whole, d).alias(f"_{n}") for n, d in zip(("d1", "d2"), parts)]).alias("m")
    right = scored.filter(whole).select("timestamp", *extra, *parts).alias("s")
    same = (
        F.col("m.timestamp").eqNullSafe(F.col("s.timestamp"))
        & (F.col("m._d1") == F.col("s.d1"))
        & (F.col("m._d2") == F.col("s.d2"))
    )
    return left.join(right, same, "left").select("m.*", *[f"s.{c}" for c in extra]).drop("_d1", "_d2")


def merge_with_sentiment(news: DataFrame, posts: DataFrame, scored: DataFrame | None):
    """merge_available with the scored columns attached, newest first."""
    merged = merge_available(news, posts)
    if scored is not None:
        merged = attach_sentiment(merged, scored)
    return _newest_first(merged)


def with_company(df: DataFrame, company: str = "company") -> DataFrame:
    """Rows whose company is resolved."""
    return df.filter(present(F.col(company)))


def latest_headlines(mentions: DataFrame, tie: list[Column], limit: int = 5) -> DataFrame:
    return mentions.orderBy(F.col("timestamp").desc_nulls_last(), *tie).limit(limit)


def headline_lists(
    mentions: DataFrame, tie: list[Column], key: Column | None = None, limit: int = 3
) -> DataFrame:
    """First `limit` headlines of each company, newest first, as (key, headlines).

    Ranks are limited per map task before the shuffle, so only `limit` rows per
    company and task travel; the list is built from ranked rows only.
    """
    key = F.upper("company") if key is None else key
    order = Window.partitionBy("company_key").orderBy(
        F.col("timestamp").desc_nulls_last(), *tie
    )
    ranked = (
        mentions.withColumn("company_key", key)
        .filter(F.col("company_key").isNotNull())
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= limit)
    )
    listed = F.array_sort(F.collect_list(F.struct("_rank", "headline")))
    return ranked.groupBy("company_key").agg(
        F.transform(listed, lambda x: x["headline"]).alias("headlines")
    )
