"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bellwether.llm.scratch import dropped, written


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written links, and a count and digest of them taken while writing."""
    seen = Observation()
    digest = F.xxhash64("u", "v")
    measured = edges.observe(
        seen, F.count("*").alias("n"), F.bit_xor(digest).alias("x"), F.sum(F.shiftright(digest, 20)).alias("s")
    )
    table = written(measured, "links")
    return table, tuple(seen.get[name] for name in ("n", "x", "s"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest neighbour of u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u")
        .join(least, "u")
        .filter("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links(a, b) that is not its component's smallest.

    Alternates large-star and small-star steps until nothing changes; every step
    is a partial minimum and an equality join, so a node with very many links is
    combined before the shuffle and split by the skew join. Ids may be any
    ordered type. Null ids and links of an id to itself are ignored; ids that
    are absent from the result are their own component.
    """
    now, state = _written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while state[0]:
        large = written(_large_star(now), "links")
        after, new = _written(_small_star(large))
        dropped(now)
        dropped(large)
        now = after
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
