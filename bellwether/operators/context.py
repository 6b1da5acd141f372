"""Per-question company tables and their text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.values import two_decimals
from bellwether.operators.entities import tickers_of

CONTEXT_SIZE = 25
QUOTE_COLUMNS = [
    "current_price", "sma_20", "sma_50", "previous_close", "day_high", "day_low", "volume",
]


def join_ignoring_case(left: DataFrame, right: DataFrame, name: str = "company"):
    """Left join on the upper-cased name; the left spelling stays.

    Of several right rows whose names differ in case only, the first spelling counts.
    """
    others = [c for c in right.columns if c != name]
    firsts = right.groupBy(F.upper(name).alias("company_key")).agg(
        F.min(F.struct(name, *others)).alias("row_")
    )
    keyed = firsts.select("company_key", *[F.col(f"row_.`{c}`").alias(c) for c in others])
    clashes = [c for c in keyed.columns if c in left.columns and c != "company_key"]
    keyed = keyed.withColumnsRenamed({c: f"{c}_right" for c in clashes})
    return (
        left.withColumn("company_key", F.upper(name))
        .join(keyed, "company_key", "left")
        .drop("company_key")
    )


def join_theme(df: DataFrame, themes: DataFrame | None) -> DataFrame:
    """Add macro_sentiment_score by theme; NULL when df has no theme or no table."""
    if themes is None or "theme" not in df.columns:
        return df.withColumn("macro_sentiment_score", F.lit(None).cast("double"))
    return df.join(themes.select("theme", "macro_sentiment_score"), "theme", "left")


def _entry(queried: bool) -> Column:
    return F.struct(
        (-F.col("growth_score")).alias("cost"),
        F.col("company"),
        F.upper("company").alias("company_key"),
        F.col("growth_score"),
        F.lit(queried).alias("queried"),
    )


def select_context(
    questions: DataFrame,
    asked: DataFrame,
    growth: DataFrame,
    size: int = CONTEXT_SIZE,
    key: str = "question_id",
) -> DataFrame:
    """Companies shown for each question, as (key, position, company, ...).

    Asked companies first, the list filled to `size` by growth score; all asked ones
    stay even beyond `size`. Without an asked company the best `size`; with asked
    companies of which none has data, nothing. The best `size` companies reach the
    questions as one scalar array of bounded length, not by a join.
    """
    best = growth.orderBy(F.desc_nulls_last("growth_score"), "company").limit(size)
    best_list = best.agg(F.array_sort(F.collect_list(_entry(False)))).scalar()
    scores = growth.select(
        F.upper("company").alias("company_key"), "company", "growth_score"
    )
    found = (
        asked.select(key, F.upper("company").alias("company_key"))
        .distinct()
        .join(scores, "company_key", "left")
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("company").isNotNull(), _entry(True)))
            ).alias("found")
        )
    )
    listed = (
        questions.select(key)
        .join(found, key, "left")
        .withColumns(
            {"best": best_list, "found_keys": F.transform("found", lambda x: x["company_key"])}
        )
    )
    others = F.filter(
        "best", lambda x: ~F.array_contains(F.col("found_keys"), x["company_key"])
    )
    room = F.greatest(F.lit(size) - F.size("found"), F.lit(0))
    chosen = (
        F.when(F.col("found").isNull(), F.col("best"))
        .when(F.size("found") == 0, F.slice("best", 1, 0))
        .otherwise(F.concat("found", F.slice(others, F.lit(1), room)))
    )
    return listed.select(key, F.posexplode(chosen).alias("position", "c")).select(
        key,
        (F.col("position") + 1).alias("position"),
        "c.company",
        "c.growth_score",
        "c.queried",
    )


def company_details(
    growth: DataFrame,
    sentiment: DataFrame,
    company_dim: DataFrame,
    quotes: DataFrame,
    headlines: DataFrame,
    themes: DataFrame | None = None,
) -> DataFrame:
    """Growth rows with sentiment, theme score, latest quote and headlines.

    headlines has (company_key, headlines); quotes are by ticker. The theme score needs a theme
    in growth or sentiment and themes (theme, macro_sentiment_score).
    """
    named = join_theme(join_ignoring_case(growth, sentiment), themes).drop("theme")
    tickers = tickers_of(growth, company_dim, name="company")
    quoted = tickers.join(quotes.select("ticker", *QUOTE_COLUMNS), "ticker", "left")
    return (
        named.join(quoted, "company", "left")
        .withColumn("company_key", F.upper("company"))
        .join(headlines, "company_key", "left")
        .drop("company_key")
    )


def company_context(selection: DataFrame, details: DataFrame) -> DataFrame:
    """Details of every selected company of every question."""
    wanted = [c for c in details.columns if c != "growth_score"]
    return selection.join(details.select(*wanted), "company", "left")


# Labels and layout of the lines below.
def context_line(headlines: str = "headlines") -> Column:
    """Text block of one company for a model's input."""
    lead = F.concat(
        F.lit("- "), F.coalesce("company", F.lit("N/A")), F.lit(":\n"),
        F.lit("  - ML Prediction for Tomorrow: "),
        F.coalesce("ml_prediction", F.lit("N/A")), F.lit("\n"),
        F.lit("  - Time-Decayed Sentiment: "),
        two_decimals(F.col("time_decayed_sentiment")), F.lit("\n"),
        F.lit("  - Overall Growth Score: "),
        two_decimals(F.col("growth_score")), F.lit("\n"),
        F.lit("  - Base Sentiment Score: "),
        two_decimals(F.col("sentiment_score")), F.lit("\n"),
        F.lit("  - Total News Mentions: "),
        F.coalesce(F.col("total_mentions").cast("string"), F.lit("N/A")), F.lit("\n"),
    )
    shown = F.concat(F.lit("  - Top Headlines: "), F.array_join(headlines, "; "))
    return F.concat(lead, F.when(F.size(headlines) > 0, shown).otherwise(F.lit("")))


def fused_line() -> Column:
    """Text block of one company of the fused table."""
    return F.concat(
        F.lit("\nCompany: "), F.col("company"),
        F.lit("\nSentiment Score: "), two_decimals(F.col("normalized_sentiment")),
        F.lit("\nML Prediction: "), F.coalesce("ml_prediction", F.lit("nan")),
        F.lit("\nFinal Score: "), two_decimals(F.col("final_score")),
    )
