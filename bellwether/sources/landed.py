"""Landed news and forum payloads to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bellwether.functions.values import epoch_to_timestamp, to_timestamp
from bellwether.schemas import NEWS_LANDED, NEWS_LISTING, POSTS_LANDED

POSTS_PER_SOURCE = 50


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """One JSON payload per line."""
    return spark.read.schema(NEWS_LANDED).json(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTS_LANDED).json(path)


def parse_news(payload: Column) -> Column:
    return F.from_json(payload, NEWS_LANDED)


def news_rows(payloads: DataFrame) -> DataFrame:
    """Articles of keyword payloads as rows; the keyword is the company."""
    article = payloads.select("keyword", F.explode("articles").alias("a"))
    return article.select(
        F.col("a.publishedAt").alias("timestamp"),
        F.lit("news").alias("source"),
        F.col("a.title").alias("headline"),
        F.col("a.description").alias("text"),
        F.col("a.url").alias("url"),
        F.col("keyword").alias("company"),
    )


def trending_rows(payloads: DataFrame) -> DataFrame:
    """Articles as they came, without a keyword."""
    article = payloads.select(F.explode("articles").alias("a"))
    return article.select(
        "a.publishedAt", "a.title", "a.description", "a.url", "a.source"
    )


def post_rows(posts: DataFrame) -> DataFrame:
    """Forum posts in the mention columns; the company is found later."""
    return posts.select(
        epoch_to_timestamp(F.col("created_utc")).alias("timestamp"),
        F.lit("reddit").alias("source"),
        F.col("title").alias("headline"),
        "text",
        "url",
        F.lit(None).cast("string").alias("company"),
    )


def cap_per_source(
    posts: DataFrame,
    order: list[Column],
    source: str = "subreddit",
    limit: int = POSTS_PER_SOURCE,
) -> DataFrame:
    """At most `limit` posts of each source.

    The rank filter is applied before the shuffle too (one limit per source and
    map task), so a source holding most rows does not reach a single task whole.
    """
    ranked = Window.partitionBy(source).orderBy(*order)
    return (
        posts.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )


def typed_news(news: DataFrame) -> DataFrame:
    return news.withColumn("timestamp", to_timestamp(F.col("timestamp")))


def read_news_listing(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of display articles (one file is one task)."""
    return spark.read.schema(NEWS_LISTING).option("multiLine", True).json(path)


def parse_listing(payload: Column) -> Column:
    return F.from_json(payload, NEWS_LISTING)


def news_listing(articles: DataFrame) -> DataFrame:
    """Display rows; missing or empty fields show their placeholder."""

    def shown(default: str, *names: str) -> Column:
        values = [F.nullif(F.col(n), F.lit("")) for n in names]
        return F.coalesce(*values, F.lit(default))

    return articles.select(
        shown("No Title", "title").alias("title"),
        shown("N/A", "source").alias("source"),
        shown("N/A", "formatted_date", "date").alias("date"),
        shown("N/A", "company_name").alias("company_name"),
        shown("", "snippet").alias("snippet"),
        shown("#", "url").alias("url"),
    )


def theme_keywords(documents: DataFrame, column: str) -> DataFrame:
    """JSON objects of theme -> [keyword, ...] as (keyword, theme) rows."""
    themes = F.from_json(F.col(column), "map<string,array<string>>")
    pairs = documents.select(F.explode(themes).alias("theme", "keywords"))
    return pairs.select(F.explode("keywords").alias("keyword"), "theme").select(
        F.lower("keyword").alias("keyword"), "theme"
    )
