"""The daily run: landed files to ranked companies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.operators import (
    entities,
    growth,
    keywords,
    mentions,
    sentiment,
    sketch,
    themes,
)
from bellwether.sources import landed, sinks


def scored_mentions(
    news: DataFrame,
    posts: DataFrame,
    company_dim: DataFrame,
    aliases: DataFrame,
    scorer: Callable[[Column], Column],
) -> DataFrame:
    """News payloads and posts merged, with company and sentiment."""
    merged = mentions.merge_sources(
        landed.news_rows(news),
        posts.withColumn("company", F.lit(None).cast("string")),
        ordered=False,
    )
    names = entities.name_list(company_dim, aliases)
    named = entities.attach_companies(merged, names)
    return sentiment.classify(named, scorer)


def reports(
    scored: DataFrame, predictions: DataFrame, theme_keywords: DataFrame, as_of=None
) -> dict[str, DataFrame]:
    """The result tables of a scored mention table."""
    by_company = sentiment.company_sentiment(scored)
    texts = keywords.distinct_texts(scored, as_of)
    wanted = keywords.top_keywords(texts)
    counted = sketch.build_sketch(keywords.keyword_feed(texts, wanted), amount=F.col("times"))
    return {
        "company_sentiment": by_company,
        "company_mentions": sentiment.company_mentions(scored),
        "company_label_counts": sentiment.label_counts(scored),
        "macro_sentiment": themes.theme_sentiment(scored, theme_keywords),
        "cms_keywords": sketch.estimate(counted, wanted),
        "edw_keywords": keywords.decayed_keywords(texts, wanted),
        "predict_growth": growth.growth_from_mentions(scored, predictions, as_of),
        "predict_growth_100": growth.growth_score_100(scored, as_of=as_of),
        "fused_scores": growth.fuse_scores(by_company, predictions),
    }


def run_daily(
    spark: SparkSession,
    news_path: str,
    posts_path: str,
    company_dim: DataFrame,
    aliases: DataFrame,
    predictions: DataFrame,
    theme_keywords: DataFrame,
    scorer: Callable[[Column], Column],
    out: str,
    as_of=None,
) -> dict[str, str]:
    """Write the mentions, the scored mentions and every report under `out`, return their paths.

    The mentions are written before they are weighed, because the default moment is
    their latest time, and the reports read the written scored mentions: landed files
    are parsed and scored once, and a lost executor costs no more than the tasks of
    one table.
    """
    mentions_path = f"{out}/mentions"
    sinks.write_table(
        scored_mentions(
            landed.read_news(spark, news_path),
            landed.read_posts(spark, posts_path),
            company_dim,
            entities.resolve_aliases(aliases, company_dim),
            scorer,
        ),
        mentions_path,
    )
    scored = sentiment.weigh_mentions(spark.read.parquet(mentions_path), as_of)
    paths = {"mentions": mentions_path, "scored_mentions": f"{out}/scored_mentions"}
    sinks.write_table(scored, paths["scored_mentions"])
    written = spark.read.parquet(paths["scored_mentions"])
    for name, table in reports(written, predictions, theme_keywords, as_of).items():
        paths[name] = f"{out}/{name}"
        sinks.write_table(table, paths[name])
    return paths
