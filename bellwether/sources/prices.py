"""Daily price bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.schemas import PRICES

DIRECTORIES = 200  # of a price table, at most
GROUP = "ticker_group"  # column of the directories that tickers share


def in_range(
    prices: DataFrame, start: str | None, end: str | None, column: str = "trade_date"
) -> DataFrame:
    """Rows with start <= date < end; a plain predicate, so it reaches the scan.

    Bounds are typed like the column, as a cast of the column would block pushdown.
    """
    data_type = prices.schema[column].dataType
    if start is not None:
        prices = prices.filter(F.col(column) >= F.lit(start).cast(data_type))
    if end is not None:
        prices = prices.filter(F.col(column) < F.lit(end).cast(data_type))
    return prices


def read_price_table(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bars of a table that write_price_table() wrote."""
    return in_range(spark.read.parquet(path), start, end).drop(GROUP)


def read_price_files(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """CSV files named <ticker>.csv with Date, Open, High, Low, Close, Volume columns."""
    bars = spark.read.option("header", True).csv(path)
    ticker = F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.csv$", 1))
    typed = bars.select(
        ticker.alias("ticker"),
        F.try_to_timestamp("Date").alias("trade_date"),
        *[
            F.col(name.capitalize()).try_cast(PRICES[name].dataType).alias(name)
            for name in PRICES.fieldNames()[2:]
        ],
    )
    return in_range(typed, start, end)


def _group() -> Column:
    return F.pmod(F.xxhash64("ticker"), F.lit(DIRECTORIES)).cast("int")


def write_price_table(prices: DataFrame, path: str) -> None:
    """One directory per ticker, so a ticker filter prunes directories.

    More than DIRECTORIES tickers share that many directories by a hash of the ticker, sorted by
    it, so the number of files does not grow with the tickers and a filter skips row groups.
    The bars of one directory and year go through one task, so a year is one file.
    """
    year = F.year("trade_date")
    if prices.select("ticker").distinct().limit(DIRECTORIES + 1).count() <= DIRECTORIES:
        prices.repartition("ticker", year).write.mode("overwrite").partitionBy("ticker").parquet(path)
        return
    columns = [c for c in prices.columns if c != "ticker"]
    grouped = prices.select(*columns, "ticker", _group().alias(GROUP)).repartition(GROUP, year)
    rows = grouped.sortWithinPartitions(GROUP, "ticker", "trade_date")
    rows.write.mode("overwrite").partitionBy(GROUP).parquet(path)


def prices_of(
    spark: SparkSession, path: str, tickers: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bars of the tickers (ticker) from a table that write_price_table() wrote.

    The list prunes directories when the join runs: its tickers, or the groups they fall in, are
    sent to the scan, which opens the directories of those only.
    """
    bars, wanted = in_range(spark.read.parquet(path), start, end), tickers.select("ticker").distinct()
    if GROUP not in bars.columns:
        return bars.join(wanted, "ticker", "left_semi")
    return bars.join(wanted.withColumn(GROUP, _group()), [GROUP, "ticker"], "left_semi").drop(GROUP)


def daily_bars(
    trades: DataFrame,
    ticker: Column,
    time: Column,
    price: Column,
    quantity: Column,
    order: list[Column],
) -> DataFrame:
    """One bar per ticker and day: first, high, low, last price and quantity.

    Partial aggregation runs before the shuffle, and later windows over a ticker
    see one row per day however many trades it has.
    """
    named = trades.select(
        ticker.alias("ticker"),
        F.date_trunc("day", time).cast("timestamp").alias("trade_date"),
        price.alias("price"),
        quantity.alias("quantity"),
        F.struct(*order, price).alias("at"),
    )
    bars = named.groupBy("ticker", "trade_date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("quantity").cast("bigint").alias("volume"),
    )
    return bars.select(*PRICES.fieldNames())
