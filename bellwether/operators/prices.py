"""Features of daily price bars.

Every input has one row per ticker and day, so a window over a ticker is as long as
its calendar; sources.prices.daily_bars gives that form for finer data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions.values import min_max

FEATURES = ["ma_5", "ma_10", "sentiment"]
STEPS = 10
SMA_DAYS = (20, 50)


def _by_date():
    return Window.partitionBy("ticker").orderBy("trade_date")


def full_frame_mean(value: Column, days: int, window) -> Column:
    """Moving average, NULL until the frame holds `days` values."""
    frame = window.rowsBetween(-(days - 1), 0)
    return F.when(F.count(value).over(frame) == days, F.avg(value).over(frame))


def price_features(prices: DataFrame) -> DataFrame:
    """Change, 5- and 10-day averages and next-day-up target, full rows only.

    The last day of a ticker has target 0.
    """
    by_date = _by_date()
    close = F.col("close")
    return (
        prices.withColumns(
            {
                "price_change": close - F.lag(close).over(by_date),
                "ma_5": full_frame_mean(close, 5, by_date),
                "ma_10": full_frame_mean(close, 10, by_date),
                "target": F.coalesce(
                    F.lead(close).over(by_date) - close > 0, F.lit(False)
                ).cast("int"),
                "is_last": F.lead("trade_date").over(by_date).isNull(),
            }
        )
        .dropna(subset=["price_change", "ma_5", "ma_10"])
    )


def with_company_sentiment(features: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Add the company's normalised sentiment to its price rows, 0 when unknown."""
    scores = sentiment.groupBy(F.col("company").alias("ticker")).agg(
        F.min("normalized_sentiment").alias("sentiment")
    )
    return features.join(scores, "ticker", "left").na.fill({"sentiment": 0.0})


def scaled_features(features: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Columns scaled to [0, 1] per ticker; a constant column becomes 0."""
    whole = Window.partitionBy("ticker")

    def scaled(name: str) -> Column:
        low, high = F.min(name).over(whole), F.max(name).over(whole)
        return F.when(high == low, F.lit(0.0)).otherwise(min_max(F.col(name), low, high))

    return features.withColumns({name: scaled(name) for name in columns})


def sequences(
    scaled: DataFrame, columns: list[str] = FEATURES, steps: int = STEPS
) -> DataFrame:
    """The `steps` rows before each row as an array, with the row's own target."""
    before = _by_date().rowsBetween(-steps, -1)
    return (
        scaled.withColumn("steps", F.collect_list(F.struct(*columns)).over(before))
        .filter(F.size("steps") == steps)
        .select("ticker", "trade_date", "steps", "target", "is_last")
    )


def latest_sequences(
    scaled: DataFrame, columns: list[str] = FEATURES, steps: int = STEPS
) -> DataFrame:
    """The last `steps` rows of each ticker as one array, the input of a prediction."""
    upto = _by_date().rowsBetween(-(steps - 1), 0)
    return (
        scaled.withColumn("steps", F.collect_list(F.struct(*columns)).over(upto))
        .filter(F.col("is_last") & (F.size("steps") == steps))
        .select("ticker", "trade_date", "steps")
    )


def known_and_latest(
    scaled: DataFrame, columns: list[str] = FEATURES, steps: int = STEPS
) -> DataFrame:
    """sequences() and latest_sequences() in one pass, told apart by known."""
    cell = F.struct(*columns)
    windows = {
        "before": F.collect_list(cell).over(_by_date().rowsBetween(-steps, -1)),
        "upto": F.collect_list(cell).over(_by_date().rowsBetween(-(steps - 1), 0)),
    }
    cases = F.array(
        F.struct(F.lit(True).alias("known"), F.col("before").alias("steps")),
        F.struct(F.lit(False).alias("known"), F.col("upto").alias("steps")),
    )
    whole = F.filter(cases, lambda c: (F.size(c["steps"]) == steps) & (c["known"] | F.col("is_last")))
    return (
        scaled.withColumns(windows)
        .select("ticker", "trade_date", "target", "is_last", F.explode(whole).alias("case"))
        .select("ticker", "trade_date", "target", "is_last", "case.known", "case.steps")
    )


def _newest_days(prices: DataFrame, days: int) -> DataFrame:
    """The newest `days` rows of each ticker; ranks are limited before the shuffle."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("trade_date"))
    return prices.withColumn("age", F.row_number().over(newest)).filter(
        F.col("age") <= days
    )


def _sma(days: int) -> Column:
    recent = F.when(F.col("age") <= days, F.col("close"))
    return F.when(F.count(recent) == days, F.avg(recent)).alias(f"sma_{days}")


def latest_averages(prices: DataFrame, days: tuple[int, ...] = SMA_DAYS) -> DataFrame:
    """Latest simple moving averages per ticker, NULL when there are too few rows."""
    return (
        _newest_days(prices, max(days)).groupBy("ticker").agg(*[_sma(n) for n in days])
    )


def latest_quotes(prices: DataFrame, days: tuple[int, ...] = SMA_DAYS) -> DataFrame:
    """Latest bar per ticker with the close before it and the moving averages.

    The price falls back to the previous close when the latest bar has none.
    """

    def at(age: int, name: str) -> Column:
        return F.max(F.when(F.col("age") == age, F.col(name)))

    quotes = _newest_days(prices, max(*days, 2)).groupBy("ticker").agg(
        at(1, "trade_date").alias("trade_date"),
        F.coalesce(at(1, "close"), at(2, "close")).alias("current_price"),
        at(2, "close").alias("previous_close"),
        at(1, "high").alias("day_high"),
        at(1, "low").alias("day_low"),
        at(1, "volume").alias("volume"),
        *[_sma(n) for n in days],
    )
    return quotes
