"""Market indicators and mood from an index and a volatility series.

A series is brought to one close per day by an aggregation; windows run over cells of
CELL_DAYS calendar days, and only one boundary row of each cell meets the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions.values import clamp

TRADING_DAYS = 252
SHORT_DAYS = 5
MEDIUM_DAYS = 20
DAYS_BACK = 30
CELL_DAYS = 64  # calendar days whose rows one window holds


def recent_days(series: DataFrame, days_back: int = DAYS_BACK) -> DataFrame:
    """Rows of the last `days_back` calendar days before the newest one."""
    newest = series.agg(F.max("trade_date")).scalar()
    return series.filter(
        F.col("trade_date") >= newest - F.expr(f"interval {int(days_back)} days")
    )


def daily_close(series: DataFrame) -> DataFrame:
    """(trade_date, close): the last known close of each day, days without one left out."""
    day = F.date_trunc("day", "trade_date").cast("timestamp").alias("trade_date")
    return (
        series.filter(F.col("close").isNotNull() & F.col("trade_date").isNotNull())
        .groupBy(day)
        .agg(F.max_by("close", F.struct("trade_date", "close")).alias("close"))
    )


def with_previous(series: DataFrame, value: str = "close", at: str = "trade_date") -> DataFrame:
    """series plus previous: the value of the row before, NULL for the first; `at` differs from row to row.

    Rows are ordered within cells of CELL_DAYS days; the first row of a cell takes the last
    value of the cell before, of which there is one row per cell.
    """
    cell = F.floor(F.unix_date(F.col(at).cast("date")) / CELL_DAYS)
    celled = series.withColumn("_cell", cell)
    within = Window.partitionBy("_cell").orderBy(at)
    lasts = celled.groupBy("_cell").agg(F.max_by(F.struct(value), at).alias("last"))
    carried = lasts.select("_cell", F.lag("last").over(Window.orderBy("_cell")).alias("_carried"))
    placed = celled.withColumns({"_place": F.row_number().over(within), "_before": F.lag(value).over(within)})
    previous = F.when(F.col("_place") > 1, F.col("_before")).otherwise(F.col(f"_carried.{value}"))
    return placed.join(carried, "_cell").withColumn("previous", previous).drop("_cell", "_place", "_before", "_carried")


def running_total(series: DataFrame, value: str = "close", at: str = "trade_date") -> DataFrame:
    """series plus total: the sum of the values up to each row, by cells and the sums of the cells before."""
    cell = F.floor(F.unix_date(F.col(at).cast("date")) / CELL_DAYS)
    celled = series.withColumn("_cell", cell)
    sums = celled.groupBy("_cell").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_earlier"))
    within = Window.partitionBy("_cell").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.sum(value).over(within), F.lit(0.0))
    return celled.withColumn("_own", own).join(earlier, "_cell").withColumn(
        "total", F.col("_own") + F.col("_earlier")
    ).drop("_cell", "_own", "_earlier")


def daily_returns(series: DataFrame) -> DataFrame:
    """(trade_date, close, change, total_change): change from the day before, and since the first day, as ratios."""
    changed = with_previous(daily_close(series)).withColumn("change", F.try_divide("close", "previous") - 1)
    logs = changed.withColumn("log_change", F.ln(F.col("change") + 1))
    return running_total(logs, "log_change").select(
        "trade_date", "close", "change", (F.exp("total") - 1).alias("total_change")
    )


def _volatility_summary(volatility: DataFrame) -> DataFrame:
    return volatility.filter(F.col("close").isNotNull()).agg(
        F.max_by("close", "trade_date").alias("vix_current"),
        F.avg("close").alias("vix_avg"),
        F.stddev_pop("close").alias("vix_std"),
        F.count("close").alias("vix_days"),
    )


def _mean_return(index: DataFrame, days: int) -> DataFrame:
    """Mean percent change over the newest `days` rows (days - 1 changes)."""
    # So many rows at most, whatever the length of the series.
    newest = daily_close(index).orderBy(F.desc("trade_date")).limit(days)
    previous = F.lag("close").over(Window.orderBy("trade_date"))
    return newest.select((F.try_divide(F.col("close"), previous) - 1).alias("change")).agg(
        (F.avg("change") * 100).alias("percent")
    )


def market_mood(index: DataFrame, volatility: DataFrame) -> DataFrame:
    """One row with the composite mood in [-1, 1].

    0.4 of minus tanh of the volatility z-score, 0.4 of the short and 0.2 of the
    medium mean return through tanh; 0 with under 2 volatility or 20 index rows.
    """
    index = daily_close(index)
    level = _volatility_summary(volatility)
    z = (F.col("vix_current") - F.col("vix_avg")) / F.col("vix_std")
    fear = F.when(F.col("vix_std") > 0, -F.tanh(z)).otherwise(F.lit(0.0))

    def trend(days: int, scale: float) -> Column:
        percent = F.coalesce(_mean_return(index, days).scalar(), F.lit(0.0))
        return F.tanh(percent / scale)

    mood = 0.4 * fear + 0.4 * trend(SHORT_DAYS, 5.0) + 0.2 * trend(MEDIUM_DAYS, 10.0)
    index_days = index.agg(F.count("*")).scalar()
    enough = (F.col("vix_days") >= 2) & (index_days >= MEDIUM_DAYS)
    return level.select(
        F.when(enough, clamp(mood, -1.0, 1.0))
        .otherwise(F.lit(0.0))
        .alias("market_sentiment")
    )


def market_indicators(index: DataFrame, volatility: DataFrame) -> DataFrame:
    """One row: volatility level, mean and spread, index return and its volatility."""
    changes = with_previous(daily_close(index)).withColumn("change", F.try_divide("close", "previous") - 1)
    moves = changes.agg(
        F.struct(
            F.max_by("close", "trade_date").alias("last"),
            F.min_by("close", "trade_date").alias("first"),
            F.stddev_pop("change").alias("spread"),
        )
    ).scalar()
    return (
        _volatility_summary(volatility)
        .withColumn("m", moves)
        .select(
            "vix_current",
            "vix_avg",
            "vix_std",
            ((F.try_divide(F.col("m.last"), F.col("m.first")) - 1) * 100).alias(
                "index_return"
            ),
            (F.col("m.spread") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias(
                "index_volatility"
            ),
        )
    )
