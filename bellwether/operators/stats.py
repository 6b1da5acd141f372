"""Summary statistics of one column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)
CELLS = 4096


def _cells(values: DataFrame, extent: Column) -> DataFrame:
    """Give each value its equal-width cell within extent (a struct low, high)."""
    low, high = extent["low"], extent["high"]
    share = (F.col("v") - low) / (high - low)
    cell = F.when(high > low, F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
    return values.withColumn("cell", F.coalesce(cell, F.lit(0)).cast("int"))


def _narrow(
    placed: DataFrame, group: list[str], with_targets: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Move each target rank to the cell that holds it.

    A running sum over the cells of a group (at most CELLS rows) gives the ranks a
    cell holds. with_targets adds to each cell the targets of its group as rows t,
    with t.rank counted within the group.
    """
    histogram = placed.groupBy(*group, "cell").agg(F.sum("n").alias("in_cell"))
    order = Window.partitionBy(*group).orderBy("cell")
    before = (F.sum("in_cell").over(order) - F.col("in_cell")).alias("before")
    held = with_targets(histogram.select(*group, "cell", "in_cell", before))
    return (
        held.withColumn("rank", F.col("t.rank") - F.col("before"))
        .filter((F.col("rank") >= 0) & (F.col("rank") < F.col("in_cell")))
        .select(*group, "cell", F.col("t").withField("rank", F.col("rank")).alias("t"))
    )


def exact_quantiles(
    df: DataFrame, column: str, shares: Sequence[float] = QUARTILES
) -> DataFrame:
    """Exact linearly interpolated quantiles, as (share, value) rows.

    Equal values are counted together first. Two histograms, the second within the
    cells of the first that hold a wanted rank and over the values really there,
    leave a sliver of the values to put in order, also when most lie close together.
    No task sees the whole column.
    """
    values = (
        df.select(F.col(column).cast("double").alias("v"))
        .filter(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("v")
        .agg(F.count("*").alias("n"))
    )
    whole = values.agg(
        F.struct(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n"))
    ).scalar()
    # Ranks are 0-based; interpolation needs the two around (n - 1) * share.
    rows = F.col("w.n")
    ranks = []
    for share in shares:
        place = (rows - 1) * F.lit(float(share))
        for up in (0, 1):
            ranks.append(
                F.struct(
                    F.lit(float(share)).alias("share"),
                    F.least(F.floor(place) + up, rows - 1).alias("rank"),
                    (place - F.floor(place)).alias("fraction"),
                    F.lit(up).alias("up"),
                )
            )
    coarse = _cells(values.withColumn("w", whole), F.col("w")).drop("w")
    in_coarse = _narrow(
        coarse,
        [],
        lambda held: held.withColumn("w", whole).withColumn("t", F.explode(F.array(*ranks))),
    ).withColumnRenamed("cell", "outer")
    kept = coarse.withColumnRenamed("cell", "outer").join(
        F.broadcast(in_coarse.select("outer").distinct()), "outer", "left_semi"
    )
    extents = kept.groupBy("outer").agg(
        F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("extent")
    )
    fine = _cells(kept.join(F.broadcast(extents), "outer"), F.col("extent"))
    # Two ranks per share: the broadcast tables hold a handful of rows.
    in_fine = _narrow(
        fine, ["outer"], lambda held: held.join(F.broadcast(in_coarse), "outer")
    )
    order = Window.partitionBy("outer", "cell").orderBy("v")
    running = fine.join(
        F.broadcast(in_fine.select("outer", "cell").distinct()), ["outer", "cell"], "left_semi"
    ).select("outer", "cell", "v", "n", F.sum("n").over(order).alias("upto"))
    hits = running.join(F.broadcast(in_fine), ["outer", "cell"]).filter(
        (F.col("t.rank") >= F.col("upto") - F.col("n")) & (F.col("t.rank") < F.col("upto"))
    )
    low = F.max(F.when(F.col("t.up") == 0, F.col("v")))
    high = F.max(F.when(F.col("t.up") == 1, F.col("v")))
    return hits.groupBy(F.col("t.share").alias("share")).agg(
        (low + (high - low) * F.max("t.fraction")).alias("value")
    )


def summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, quartiles and max as one row; NaN counts as missing."""
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    quantiles = (
        exact_quantiles(df, column)
        .agg(F.map_from_entries(F.collect_list(F.struct("share", "value"))))
        .scalar()
    )

    def at(share: float, name: str) -> Column:
        return F.try_element_at("q", F.lit(share)).alias(name)

    return (
        df.agg(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
        .withColumn("q", quantiles)
        .select(
            "count", "mean", "std", "min",
            at(0.25, "q25"), at(0.5, "q50"), at(0.75, "q75"), "max",
        )
    )


def value_counts(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """Most frequent values with their counts."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
        .limit(limit)
    )
