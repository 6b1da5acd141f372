"""Count-min sketch as a relation (depth, bucket, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = {"width": 1000, "depth": 10}
NARROW = {"width": 500, "depth": 5}


def _cells(key: Column, width: int, depth: int) -> Column:
    """The bucket of a key in every row of the sketch.

    Two halves of one md5 give all rows (h1 + row * h2), so a key is hashed once.
    """
    digest = F.md5(key)
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    second = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return F.transform(
        F.sequence(F.lit(0), F.lit(depth - 1)),
        lambda row: F.struct(
            row.alias("depth"), ((first + row * second) % width).alias("bucket")
        ),
    )


def build_sketch(
    feed: DataFrame,
    key: str = "keyword",
    amount: Column | None = None,
    width: int = NARROW["width"],
    depth: int = NARROW["depth"],
) -> DataFrame:
    """Sketch of a feed of keys, each adding `amount` (default 1).

    Equal keys are added up first (per map task, then over all), so each distinct key
    is hashed once and a frequent key costs no more than a rare one.
    """
    amount = F.lit(1) if amount is None else amount
    totals = feed.groupBy(key).agg(F.sum(amount).alias("n"))
    return (
        totals.select("n", F.inline(_cells(F.col(key), width, depth)))
        .groupBy("depth", "bucket")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def merge_sketches(one: DataFrame, other: DataFrame) -> DataFrame:
    return (
        one.unionByName(other)
        .groupBy("depth", "bucket")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def estimate(
    sketch: DataFrame,
    keys: DataFrame,
    key: str = "keyword",
    width: int = NARROW["width"],
    depth: int = NARROW["depth"],
) -> DataFrame:
    """Estimated count per distinct key, never below the true one; absent keys get 0."""
    cells = keys.select(key).distinct().select(
        key, F.inline(_cells(F.col(key), width, depth))
    )
    return (
        cells.join(sketch, ["depth", "bucket"], "left")
        .groupBy(key)
        .agg(F.min(F.coalesce("n", F.lit(0))).cast("bigint").alias("count"))
    )


def builtin_sketch(
    feed: DataFrame, key: str = "keyword", eps: float = 0.004, confidence: float = 0.96875,
    seed: int = 42,
) -> DataFrame:
    """The same structure as one mergeable binary value."""
    return feed.agg(
        F.count_min_sketch(F.col(key), F.lit(eps), F.lit(confidence), F.lit(seed)).alias(
            "sketch"
        )
    )
