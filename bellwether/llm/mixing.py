"""Mixing sources to target weights by entropy balancing, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.llm.scratch import written

WEIGHTS = (1, 2, 3)
CAP = 3
CLOSE = 1e-9
CORRECTIONS = 3
CELL = 1024  # rows that one task ranks together, about


def word_count(text: Column | str) -> Column:
    """Runs without space, tab, line feed, vertical tab, form feed or carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _exact(value: Column) -> Column:
    # Decimal sums do not depend on the order of the rows, so reruns agree.
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, no, source_size, target) of every source of sized(source, size).

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes; a target stops at cap times its source's size, and the
    excess goes to the others by weight. That is min(limit, level * weight) with
    one level for all: the level at which the sources with the lowest limit per
    weight are full and the others take the rest. Windows run over one row per
    source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    no = F.row_number().over(by_name) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(no, F.lit(len(weights)))]
    named = per_source.withColumns({"no": no, "weight": weight}).withColumn(
        "limit", cap * F.col("source_size").cast("double")
    )
    everyone = Window.partitionBy()
    from_lowest = Window.orderBy(F.col("limit") / F.col("weight"), "no")
    before = from_lowest.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = named.withColumn("level", rest / open_weight).withColumn(
        "fits", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    )
    level = F.max("fits").over(everyone)
    first = F.min(F.when(F.col("fits").isNotNull(), F.col("limit") / F.col("weight"))).over(everyone)
    return levelled.withColumns({"level": level, "first": first}).select(
        "source",
        "no",
        "source_size",
        F.when(
            F.col("first").isNotNull() & (F.col("limit") / F.col("weight") >= F.col("first")),
            F.least(F.col("limit"), F.col("level") * F.col("weight")),
        )
        .otherwise(F.col("limit"))
        .alias("target"),
    )


def _rate(tilt: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(tilt * F.col("z"), F.lit(50.0))))


def _balanced(cells: DataFrame, aims: DataFrame, cap: int) -> DataFrame:
    """(no, tilt): the solution of the dual, by safeguarded Newton steps.

    The rates closest to 1 in relative entropy that meet a source's token
    constraint are min(cap, exp(tilt * z)), z the size over the source's mean.
    Every step sums the constraint and its slope over all cells of all sources,
    then moves each source's tilt; a step that leaves the bracket halves it.
    """
    spread = cells.filter("size > 0").groupBy("no").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("small")
    )
    z_small = F.col("small") / F.col("mean")
    ratio = F.col("target") / F.col("source_size")
    state = (
        aims.filter("source_size > 0")
        .join(spread, "no")
        .select(
            "no",
            "target",
            "mean",
            F.lit(0.0).alias("tilt"),
            F.least(F.log(ratio), F.lit(0.0)).__truediv__(z_small).alias("low"),
            F.when(ratio >= 1, F.log(F.lit(float(cap))) / z_small).otherwise(0.0).alias("high"),
            (ratio >= cap * (1 - 1e-12)).alias("full"),
        )
    )
    state = written(state.withColumn("tilt", F.when(F.col("full"), F.col("high")).otherwise(F.col("tilt"))), "tilts")
    shape = cells.select("no", "size", "n")
    while True:
        rated = (
            shape.join(state.filter("not full"), "no")
            .withColumn("z", F.col("size") / F.col("mean"))
            .withColumn("rate", _rate(F.col("tilt"), cap))
            .withColumn("tokens", F.col("n") * F.col("size") * F.col("rate"))
        )
        slope = F.when(F.col("rate") < cap, F.col("tokens") * F.col("z")).otherwise(0.0)
        sums = rated.groupBy("no").agg(_exact(F.col("tokens")).alias("got"), _exact(slope).alias("slope"))
        moved = state.join(sums, "no", "left")
        under = F.col("got") < F.col("target")
        low = F.when(under, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(under, F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        done = F.col("full") | (F.abs(F.col("got") - F.col("target")) <= CLOSE * F.col("target"))
        done = done | (F.col("high") - F.col("low") <= 1e-12 * F.greatest(F.abs("high"), F.lit(1.0)))
        moved = moved.withColumns({"low": low, "high": high, "step": step, "done": done}).select(
            "no",
            "target",
            "mean",
            F.when(F.col("done"), F.col("tilt"))
            .when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step"))
            .otherwise((F.col("low") + F.col("high")) / 2)
            .alias("tilt"),
            "low",
            "high",
            "full",
            "done",
        )
        after = written(moved, "tilts")
        if after.filter("not done").isEmpty():
            return after.select("no", "tilt", "mean")
        state = after.drop("done")


def _corrected(wanted: DataFrame, cap: int) -> DataFrame:
    """One copy more or less of the largest size that the source's error still holds."""
    source = Window.partitionBy("no")
    error = F.sum(F.col("copies") * F.col("size")).over(source) - F.col("target")
    room = F.when(F.col("error") > 0, F.col("copies") > 0).otherwise(F.col("copies") < cap * F.col("n"))
    fits = F.when(room & (F.col("size") > 0) & (F.col("size") <= F.abs("error")), F.col("size"))
    return (
        wanted.withColumn("error", error)
        .withColumn("fits", F.max(fits).over(source))
        .withColumn(
            "copies",
            F.when(F.col("size") == F.col("fits"), F.col("copies") - F.signum("error").cast("long")).otherwise(
                F.col("copies")
            ),
        )
        .drop("error", "fits")
    )


def copy_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size, source_size, target, base, mark, share): copies of every document of a source and size.

    sized holds (doc_id, tid, source, size), one row per document, tid being a hash of its text. A
    document takes base copies, and one more if draw(doc_id, tid) is under mark, or is mark and
    the row belongs to the share of the equal rows that is still wanted. Within a source,
    sizes ascend and the running sum of wanted copies is rounded, which misses the
    target by less than the largest document; single copies of fitting size then
    take the rest of the error away.
    """
    sized = written(sized.select("doc_id", "tid", "source", "size"), "sizes")
    counted = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = counted.select("source", (F.col("size") * F.col("n")).alias("size"))
    aims = written(targets(totals, weights, cap), "targets")
    same = counted["source"].eqNullSafe(aims["source"])
    cells = counted.join(aims, same).select(aims["source"], "no", "size", "n", "source_size", "target")
    tilts = _balanced(cells, aims, cap)
    upward = Window.partitionBy("no").orderBy("size")
    wanted = (
        cells.join(tilts, "no", "left")
        .withColumn("z", F.col("size") / F.col("mean"))
        .withColumn("rate", F.coalesce(_rate(F.col("tilt"), cap), F.lit(1.0)))
        .withColumn("upto", F.floor(F.sum(F.col("n") * F.col("rate")).over(upward) + 0.5))
        .withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(upward), F.lit(0)))
        .withColumn("copies", F.least("copies", cap * F.col("n")))
    )
    for _ in range(CORRECTIONS):
        wanted = _corrected(wanted, cap)
    wanted = (
        wanted.withColumn("base", F.floor(F.col("copies") / F.col("n")))
        .withColumn("more", F.col("copies") - F.col("base") * F.col("n"))
    )
    wanted = written(wanted, "wanted")
    partly = wanted.filter("more > 0").select("source", "size", "no", "n", "more")
    # Equal rows draw alike, so draws are counted before they are ordered.
    drawn = (
        sized.join(partly.withColumnRenamed("source", "s").withColumnRenamed("size", "z"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
        .groupBy("no", "size", "n", "more", draw("doc_id", "tid").alias("drawn"))
        .agg(F.count("*").alias("ties"))
        .withColumn("part", F.floor(F.col("drawn") / F.lit(2.0**63) * F.ceil(F.col("n") / CELL)))
    )
    parts = drawn.groupBy("no", "size", "part").agg(F.sum("ties").alias("rows"))
    earlier = Window.partitionBy("no", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    within = F.sum("ties").over(Window.partitionBy("no", "size", "part").orderBy("drawn"))
    last = F.min(F.struct("drawn", "ties", "upto", "more")).alias("last")
    marks = (
        drawn.withColumn("within", within)
        .join(parts, ["no", "size", "part"])
        .withColumn("upto", F.col("before") + F.col("within"))
        .filter(F.col("upto") >= F.col("more"))
        .groupBy("no", "size")
        .agg(last)
    )
    missing = F.col("last.more") - F.col("last.upto") + F.col("last.ties")
    return written(
        wanted.join(marks, ["no", "size"], "left").select(
            "source",
            "size",
            "source_size",
            "target",
            "base",
            F.coalesce("last.drawn", F.lit(-1)).alias("mark"),
            F.coalesce(missing / F.col("last.ties"), F.lit(0.0)).alias("share"),
        ),
        "copies",
    )


def draw(*columns: Column | str) -> Column:
    """A fixed draw of a row, from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.xxhash64("text").alias("tid"), "source", word_count("text").alias("size"),
        draw(F.monotonically_increasing_id()).alias("row_draw"),
    )


def _copies(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, Column]:
    """rows(doc_id, tid, source, size, row_draw) joined with their plan, and the copies of a row.

    Of the equal rows at the mark a share is taken, by their place in the input.
    """
    same = rows["source"].eqNullSafe(plan["source"]) & (rows["size"] == plan["size"])
    own = draw(rows["doc_id"], rows["tid"])
    tie = (own == plan["mark"]) & (rows["row_draw"] < plan["share"] * F.lit(2.0**63))
    return rows.join(plan, same), plan["base"] + F.when((own < plan["mark"]) | tie, 1).otherwise(0)


def taken_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as they are (see mixed_sources)."""
    plan = copy_plan(_sized(docs), weights, cap)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(whole).select("row", "row.doc_id", F.xxhash64("row.text").alias("tid"), "row.source")
    rows = rows.withColumns({"size": word_count("row.text"), "row_draw": draw(F.monotonically_increasing_id())})
    joined, copies = _copies(rows, plan)
    repeated = joined.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("copy"))
    return repeated.select("row.*")


def mixed_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs(doc_id, text, source).

    size counts the words of the whole text; taken is copies times size, at most
    cap times the size. Null texts, empty texts and texts without words have size 0 and
    are taken once. A null source is a source, the last one; a null doc_id is an
    id like any other. Rows that repeat a doc_id and a text are taken as often as their source's
    target asks for, some of them once more than the others: which ones follows from their place
    in the input. An empty table gives no rows; other columns are ignored.
    """
    sized = _sized(docs)
    plan = copy_plan(sized, weights, cap)
    joined, copies = _copies(sized, plan)
    return joined.select(
        sized["doc_id"],
        sized["size"],
        plan["source_size"],
        plan["target"],
        copies.alias("copies"),
        (copies * sized["size"]).alias("taken"),
    )
