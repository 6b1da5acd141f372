"""Links between the members of shared buckets, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.llm.components import components
from bellwether.llm.scratch import dropped, written

PIVOTS, GROWTH = 64, 4  # pivots of a bucket in the second round, and how many times more in each later one
SMALL = 256  # members of a bucket that need no screening
CELL = 1024  # members that one task ranks together, about


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label(id, component) after links(a, b) between components."""
    joins = components(links)
    moved = joins.select(F.col("id").alias("from"), F.col("component").alias("to"))
    return written(
        label.join(moved, F.col("component") == F.col("from"), "left")
        .select("id", F.coalesce("to", "component").alias("component"))
        .unionByName(joins),
        "labels",
    )


def ranked(members: DataFrame) -> DataFrame:
    """members(key, id, others, ...) plus place, from 1 within a key, others being the key's rows.

    Members fall into cells by a hash of their id; places count within a cell,
    after the cells before it, so no task gets a whole large bucket.
    """
    celled = members.withColumn("cell", F.pmod(F.xxhash64("id"), F.ceil(F.col("others") / CELL)))
    counts = celled.groupBy("key", "cell").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("key", "cell").orderBy("id"))
    return (
        celled.withColumn("within", within)
        .join(offsets, ["key", "cell"])
        .withColumn("place", F.col("offset") + F.col("within"))
        .drop("cell", "offset", "within")
    )


def _undecided(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows(key, id, ...) of keys that still hold two components, plus component, core, size and others.

    core is the component with the most rows of the key, others the rows outside it.
    """
    named = rows.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = (
        parts.groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
        .filter("top.n < size")
        .select("key", "size", F.col("top.component").alias("core"), (F.col("size") - F.col("top.n")).alias("others"))
    )
    return named.join(keys, "key")


def _between(links: DataFrame, label: DataFrame) -> DataFrame:
    """links(a, b) of ids as links of their components."""
    for end in ("a", "b"):
        names = label.select(F.col("id").alias(end), F.col("component").alias("named"))
        links = links.join(names, end, "left").withColumn(end, F.coalesce("named", end)).drop("named")
    return links.filter("a <> b").distinct()


def _with_smallest(buckets: DataFrame, carried: list[str]) -> DataFrame:
    """buckets without the smallest id of each key, which stands beside the others as b, its columns with _2."""
    tops = buckets.groupBy("key").agg(F.min(F.struct("id", *carried)).alias("top"))
    heads = tops.select("key", F.col("top.id").alias("b"), *[F.col(f"top.{c}").alias(f"{c}_2") for c in carried])
    return buckets.join(heads, "key").filter(F.col("id") != F.col("b"))


def bucket_components(
    buckets: DataFrame,
    near: Column,
    verify: Callable[[DataFrame], DataFrame],
    screen: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    label: DataFrame | None = None,
) -> DataFrame:
    """(id, component) of the ids that are not the smallest of their component.

    buckets holds (key, id) and carried columns that depend on the id; ids are
    long, a bucket holds an id once. Two members of a bucket link if near holds
    (over the carried columns, those of the second member with _2 at the end) and
    verify keeps their pair: it gets (a, b) plus further columns and returns the
    rows that link.

    Every id is first compared with one, the smallest that it meets in a bucket; then every bucket
    that still holds two components compares all members with its smallest, a row per member.
    Buckets whose members then still belong to several components go on: members
    outside the bucket's largest component are pivots and meet all members of
    other components, 64 of them in the next round, 256 in the one after. The
    rounds end when no bucket holds an undecided pair of two components, so all
    links that could join components are found; only pairs within one are left out.
    For the members of buckets with more than SMALL undecided rows, screen may put all
    pairs with some property into buckets of their own and tell what bounds the others: it
    gets (id) and returns (id, ..., alone) and such buckets. These are decided in the
    same way; all other pairs meet in the large buckets with the new values of the carried
    columns, and ids that are alone leave them. Smaller buckets stay as they are.
    label (id, component) tells what is known already: only buckets that hold two components count.
    """
    carried = [c for c in buckets.columns if c not in ("key", "id")]
    if label is None:
        # One pair of each id first: in a large group the smallest members of its buckets differ,
        # and most of their pairs are decided by these few.
        near_pairs = _with_smallest(buckets, carried).filter(near)
        label = components(verify(near_pairs.groupBy(F.col("id").alias("a")).agg(F.min("b").alias("b"))))
    apart = written(_undecided(buckets, label).select("key", "id", "component", *carried), "undecided")
    compared = _with_smallest(apart, ["component", *carried])
    pairs = compared.filter((F.col("component") != F.col("component_2")) & near).select(F.col("id").alias("a"), "b")
    label = merged(label, _between(verify(pairs.distinct()), label))
    rows = compared.select("key", "id", *carried)

    pivots, screened, source = PIVOTS, screen is None, None
    while True:
        pending = written(_undecided(rows, label), "pending")
        if source is not None:
            dropped(source)  # the table that rows came from
        source = pending
        if pending.isEmpty():
            return label
        if not screened:
            screened = True
            told, special = screen(pending.filter(F.col("size") > SMALL).select("id").distinct())
            news = [c for c in told.columns if c in carried]
            told = told.withColumnsRenamed({c: f"new_{c}" for c in news})
            # A smaller key can hold ids that were not screened, of which nothing is told.
            large = F.col("size") > SMALL
            sharper = pending.join(told, "id", "left").filter(~large | F.col("alone").isNull() | ~F.col("alone"))
            for c in news:
                sharper = sharper.withColumn(c, F.when(large, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)))
            rows = sharper.select("key", "id", *carried)
            label = bucket_components(special, near, verify, label=label)
            continue
        outer = ranked(pending.filter("component <> core")).select("key", "id", "place")
        # Members of the core come after all pivots.
        placed = written(pending.join(outer, ["key", "id"], "left"), "placed")
        heads = placed.filter(F.col("place") <= pivots).select(
            "key",
            F.col("id").alias("b"),
            F.col("component").alias("b_component"),
            F.col("place").alias("b_place"),
            *[F.col(c).alias(f"{c}_2") for c in carried],
        )
        apart = (F.col("component") != F.col("b_component")) & (
            F.col("place").isNull() | (F.col("b_place") < F.col("place"))
        )
        pairs = (
            placed.join(heads, "key")
            .filter(apart & near)
            .select(F.col("id").alias("a"), "b", "component", "b_component")
            .distinct()
        )
        links = verify(pairs).select(F.col("component").alias("a"), F.col("b_component").alias("b"))
        label = merged(label, links)
        rows = placed.filter(F.col("place").isNull() | (F.col("place") > pivots)).select("key", "id", *carried)
        dropped(pending)
        source = placed
        pivots *= GROWTH
