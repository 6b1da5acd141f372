"""Fuzzy line dedup by SimHash, pigeonhole blocks and edit similarity, in DataFrame functions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.llm.buckets import bucket_components
from bellwether.llm.membership import impossible, possible
from bellwether.llm.scratch import dropped, written

DISTANCE = 7  # SimHash bits that may differ; one changed word of 20 to 29 moves about 5
BLOCKS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)  # bits; with 7 differing bits, 3 of the 10 blocks agree
AGREE = len(BLOCKS) - DISTANCE
PERCENT = 80  # edit similarity of linked lines, at least
FEW = 32  # edits that are looked for before all that PERCENT allows
# Bits of a SimHash side by side, and how many of them may differ: with 7 differing bits, one span differs in no more.
SPANS = ((22, 2), (21, 2), (21, 1))
PART = 12  # bits that hold a part of a span
_WIDE = max(width for width, _ in SPANS)
SHORT_STEP, LONG_STEP = 16, 32  # bits of a count of words in lines of up to 32,766 letters, and in longer ones
_BY_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def normalised(low: Column) -> Column:
    """A lower-case line with runs of white space as one blank, none at the ends."""
    # Most lines hold single blanks only, which a plain search tells faster than a pattern.
    odd = reduce(lambda a, b: a | b, [low.contains(x) for x in ("  ", "\t", "\r", "\v", "\f")])
    return F.trim(F.when(odd, F.regexp_replace(low, r"[ \t\x0B\f\r]+", " ")).otherwise(low))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, pos, k1, k2, chars, line) of every line with a word, normalised."""
    # Hash and split come first, so that neither is repeated for every line; the outer
    # form keeps the optimizer from splitting once more to look for empty arrays.
    parts = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.split(F.lower("text"), "\n").alias("parts"))
    found = parts.select("doc_id", "tid", F.posexplode_outer("parts").alias("pos", "raw"))
    worded = found.filter(F.col("raw").rlike(r"[^ \t\x0B\f\r]"))
    return worded.select("doc_id", "tid", "pos", normalised(F.col("raw")).alias("line")).select(
        "doc_id",
        "tid",
        "pos",
        F.xxhash64("line").alias("k1"),
        F.xxhash64(F.lit(1), "line").alias("k2"),
        F.length("line").alias("chars"),
        "line",
    )


def _simhash(lines: DataFrame) -> DataFrame:
    """(doc_id, tid, pos, k1, k2, chars, sim) of every line.

    Bit j of sim is set if more than half of the line's different words have it in
    their hash. A sum over the words is complete in the task that reads the line, so one
    row per line is shuffled.
    """
    # A line of n letters has (n + 1) / 2 words at most.
    short = F.col("chars") < (1 << SHORT_STEP - 1) - 1
    return _counted(lines.filter(short), SHORT_STEP).unionByName(_counted(lines.filter(~short), LONG_STEP))


def _counted(lines: DataFrame, step: int) -> DataFrame:
    """_simhash() of lines of less than 2^(step - 2) words: a sum counts a bit of every step together, step bits each."""
    place = ["doc_id", "tid", "pos", "k1", "k2", "chars"]
    ones, half = sum(1 << at for at in range(0, 64, step)), 1 << (step - 2)
    words = F.explode(F.array_distinct(F.split("line", " "))).alias("word")
    hashes = lines.select(*place, words).select(*place, F.xxhash64("word").alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(ones))).alias(f"s{j}") for j in range(step)]
    counted = hashes.groupBy(*place).agg(F.count("*").alias("words"), *sums)
    # Counts above words / 2 carry into bit step - 2 of their place.
    lift = (half - 1 - F.floor(F.col("words") / 2)) * F.lit(ones)
    bits = [F.shiftrightunsigned(F.col(f"s{j}") + lift, step - 2).bitwiseAND(F.lit(ones)) for j in range(step)]
    sim = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(bit, j) for j, bit in enumerate(bits)])
    return counted.select(*place, sim.alias("sim"))


def _parts() -> list[tuple[int, int, int, int, list[int]]]:
    """(start and width of a span, start and width of a part of it, masks) of every part.

    If two SimHashes differ in at most DISTANCE bits, they differ in no more than its radius in one
    of the spans, so one of its radius + 1 parts is equal. masks has every way in which the
    rest of the span may then differ, the earlier parts all differing.
    """
    found, start = [], 0
    for width, radius in SPANS:
        cuts = [width * n // (radius + 1) for n in range(radius + 2)]
        parts = [((1 << high) - (1 << low)) for low, high in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
        for n, part in enumerate(parts):
            own = [m for m in masks if not m & part and all(m & earlier for earlier in parts[:n])]
            found.append((start, width, cuts[n], cuts[n + 1] - cuts[n], own))
        start += width
    return found


def _of_spans(sim: str) -> Column:
    """The bits of each span of a SimHash, the number of the span above bit 22."""
    starts = [sum(width for width, _ in SPANS[:n]) for n in range(len(SPANS))]
    return F.array(
        *[
            F.lit(n << _WIDE).bitwiseOR(F.shiftrightunsigned(sim, start).bitwiseAND(F.lit((1 << width) - 1)).cast("int"))
            for n, (start, (width, _)) in enumerate(zip(starts, SPANS, strict=True))
        ]
    )


def _neighbours(sims: DataFrame) -> DataFrame:
    """(sim) of the different sims(sim) that have one within DISTANCE next to theirs, ordered by a span.

    It misses those with few others nearby, hardly one of a large group.
    """
    starts = [sum(width for width, _ in SPANS[:n]) for n in range(len(SPANS))]
    turned = F.array(*[F.shiftleft("sim", 64 - at).bitwiseOR(F.shiftrightunsigned("sim", at)) for at in starts])
    rows = sims.select("sim", F.explode(F.arrays_zip(_of_spans("sim").alias("span"), turned.alias("turned"))).alias("order"))
    beside = Window.partitionBy("span").orderBy("turned")
    apart = [F.bit_count(F.col("sim").bitwiseXOR(other("sim").over(beside))) for other in (F.lag, F.lead)]
    rows = rows.select("sim", "order.span", "order.turned").withColumn("apart", F.least(*apart))
    return rows.filter(F.col("apart") <= DISTANCE).select("sim").distinct()


def _cells(known: DataFrame) -> DataFrame:
    """(cell, sims, fresh): the SimHashes of known(sim, seen) that hold the same bits in a span, those not yet seen first.

    cell is the number of the span and its bits, fresh how many of sims are not seen.
    """
    rows = known.select("sim", "seen", F.explode(_of_spans("sim")).alias("cell"))
    held = rows.groupBy("cell").agg(
        F.collect_list(F.when(~F.col("seen"), F.col("sim"))).alias("fresh"),
        F.collect_list(F.when(F.col("seen"), F.col("sim"))).alias("settled"),
    )
    return held.select("cell", F.concat("fresh", "settled").alias("sims"), F.size("fresh").alias("fresh"))


def _met(distinct: DataFrame) -> DataFrame:
    """(id) of the lines of distinct(id, sim, ...) whose SimHash is within DISTANCE of another line's.

    Different SimHashes with the same bits in a span share a cell, which goes once to the task of each part of the
    span. There the cells whose bits differ as the masks tell are looked up, so these rows are never shuffled or
    written, and two cells that meet compare their arrays. SimHashes that a neighbour or an equal
    one settles beforehand are not paired with each other, so a large group does not give all its pairs.
    """
    spark, parts = distinct.sparkSession, _parts()
    sims = written(distinct.groupBy("sim").agg((F.count("*") > 1).alias("several")), "sims")
    found = written(_neighbours(sims).union(sims.filter("several").select("sim")).distinct(), "found")
    known = sims.select("sim").join(found.withColumn("seen", F.lit(True)), "sim", "left")
    # Nothing here is null; said so, both sides of the join share one exchange.
    cells = _cells(
        known.select(
            F.coalesce("sim", F.lit(0).cast("long")).alias("sim"), F.coalesce("seen", F.lit(False)).alias("seen")
        )
    )
    own = F.col("cell").bitwiseAND(F.lit((1 << _WIDE) - 1))
    # Part n of all parts, with the bits of the cell that lie in it, for the parts of the cell's span.
    keys = [
        (start, F.lit(n << PART).bitwiseOR(F.shiftright(own, low).bitwiseAND(F.lit((1 << wide) - 1))))
        for n, (start, _, low, wide, _) in enumerate(parts)
    ]
    of_span = [F.array(*[key for at, key in keys if at == start]) for start in dict.fromkeys(at for at, _ in keys)]
    placed = cells.select("sims", "fresh", own.alias("own"), F.explode(_case(F.shiftright("cell", _WIDE), of_span)).alias("part"))
    placed = placed.repartition("part")
    held = placed.select(
        "part", F.col("own").alias("span"), F.col("sims").alias("sims_2"), F.col("fresh").alias("fresh_2")
    )
    masks = _case(F.shiftright("part", PART), [F.array(*[F.lit(m) for m in part[4]]) for part in parts])
    asked = placed.withColumn("mask", F.explode(masks)).withColumn("span", F.col("own").bitwiseXOR(F.col("mask")))
    # Of two cells the smaller one asks for the larger.
    asked = asked.filter((F.col("span") >= F.col("own")) & ((F.col("mask") > 0) | (F.size("sims") > 1))).drop("own")
    meeting = asked.join(held.hint("shuffle_hash"), ["part", "span"]).filter("fresh > 0 or fresh_2 > 0")
    # The outer forms keep the optimizer from looking for empty arrays below one side's exchange.
    one = meeting.select("mask", "fresh", "sims_2", "fresh_2", F.posexplode_outer("sims").alias("at", "sim"))
    new, new_2 = F.col("at") < F.col("fresh"), F.col("at_2") < F.col("fresh_2")
    others = F.when(new, F.col("sims_2")).otherwise(F.slice("sims_2", F.lit(1), F.col("fresh_2")))
    near = F.bit_count(F.col("sim").bitwiseXOR(F.col("sim_2"))) <= DISTANCE
    pairs = one.select("mask", "fresh", "fresh_2", "at", "sim", F.posexplode_outer(others).alias("at_2", "sim_2")).filter(
        near & ((F.col("mask") > 0) | (F.col("sim") < F.col("sim_2")))
    )
    before = spark.conf.get(_BY_ALL_KEYS)
    spark.conf.set(_BY_ALL_KEYS, "false")  # rows lie by part, which is enough for a join by part and span
    try:
        ends = F.array_compact(F.array(F.when(new, F.col("sim")), F.when(new_2, F.col("sim_2"))))
        lone = written(pairs.select(F.explode(ends).alias("sim")).distinct(), "lone")
    finally:
        spark.conf.set(_BY_ALL_KEYS, before)
    met = written(distinct.select("id", "sim").join(found.union(lone), "sim", "left_semi").select("id"), "met")
    for done in (sims, found, lone):
        dropped(done)
    return met


def _case(number: Column, values: list[Column]) -> Column:
    """The value with that number."""
    last = len(values) - 1
    cases = reduce(lambda c, n: c.when(number == n, values[n]), range(1, last), F.when(number == 0, values[0]))
    return cases.otherwise(values[last])


def _block_keys(lines: DataFrame) -> DataFrame:
    """lines(id, sim, ...) plus key, a row per choice of AGREE blocks: the choice's number and the bits of its blocks."""
    starts = [sum(BLOCKS[:n]) for n in range(len(BLOCKS))]
    blocks = F.array(
        *[
            F.shiftrightunsigned("sim", start).bitwiseAND(F.lit((1 << width) - 1))
            for start, width in zip(starts, BLOCKS, strict=True)
        ]
    )
    # The choices are rows of one literal, so the plan does not hold an expression for each of them.
    choices = F.array(*[F.array(*map(F.lit, chosen)) for chosen in combinations(range(len(BLOCKS)), AGREE)])
    chosen = lines.select(*lines.columns, blocks.alias("blocks"), F.posexplode(choices).alias("number", "chosen"))
    key = F.col("number").cast("long")
    for n in range(AGREE):
        key = F.shiftleft(key, max(BLOCKS)).bitwiseOR(F.get("blocks", F.get("chosen", F.lit(n))))
    return chosen.select(*lines.columns, key.alias("key"))


def _edits_in_place(x: str, y: str) -> Column:
    """Letters that change if the n-th word of x becomes the n-th of y, and words left over come or go."""
    changed = F.zip_with(
        F.split(x, " "),
        F.split(y, " "),
        lambda a, b: F.when(a == b, 0)
        .when(a.isNull(), F.length(b) + 1)
        .when(b.isNull(), F.length(a) + 1)
        .otherwise(F.greatest(F.length(a), F.length(b))),
    )
    return F.aggregate(changed, F.lit(0), lambda total, n: total + n)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, removed): positions of the lines of each text that an earlier line makes redundant.

    tid tells texts of a repeated doc_id apart. Lines link if they are equal when
    normalised, or if their SimHashes differ in at most DISTANCE bits and their edit
    similarity (1 - edits / longer length) is at least PERCENT. Of every connected group the
    occurrence with the smallest doc_id, tid and position stays; the rest are removed.
    """
    lines = written(_lines(docs), "lines", compression="zstd")
    where = F.struct("doc_id", "tid", "pos")
    firsts = _simhash(lines).groupBy("k1", "k2").agg(
        F.min(where).alias("first"),
        F.count("*").alias("times"),
        F.max("chars").alias("chars"),
        F.max("sim").alias("sim"),
    )
    distinct = written(firsts.withColumn("id", F.monotonically_increasing_id()), "distinct")
    met = _met(distinct)
    wanted = written(distinct.join(met, "id", "left_semi").select("id", "sim", "chars", "first.*"), "wanted")
    near = (F.bit_count(F.col("sim").bitwiseXOR(F.col("sim_2"))) <= DISTANCE) & (
        100 * F.least("chars", "chars_2") >= PERCENT * F.greatest("chars", "chars_2")
    )
    # Most keys that two lines share are equal by chance, more of them the more lines there are: only rows with a near
    # one in their bucket go on. Nothing is null; said so, both sides share one exchange. A row of wanted becomes
    # 120 of keyed, which Spark does not count, so by the size of wanted they would be broadcast.
    keyed = _block_keys(wanted.select("id", "sim", "chars"))
    keyed = keyed.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in keyed.columns])
    other = keyed.select(*[F.col(c).alias(f"{c}_2") for c in keyed.columns])
    partner = (F.col("key") == F.col("key_2")) & (F.col("id") != F.col("id_2")) & near
    buckets = written(keyed.join(other.hint("merge"), partner, "left_semi").select("key", "id", "sim", "chars"), "buckets")
    place = ["doc_id", "tid", "pos"]
    texts = written(
        possible(lines.select(*place, "line"), place, wanted.select(*place))
        .join(
            wanted.select("id", *place).toDF("id", "of", "of_tid", "of_pos"),
            F.col("doc_id").eqNullSafe(F.col("of"))
            & (F.col("tid") == F.col("of_tid"))
            & (F.col("pos") == F.col("of_pos")),
        )
        .groupBy("id")
        .agg(F.min("line").alias("line")),
        "texts",
    )

    def verify(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
        b = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
        both = pairs.join(a, "a").join(b, "b")
        most = F.floor(F.greatest(F.length("x"), F.length("y")) * (100 - PERCENT) / 100).cast("int")
        # Edits in place, word by word, are an upper bound that settles most pairs; few edits are told faster than many.
        in_place = _edits_in_place("x", "y") <= F.col("most")
        few, exact = (F.expr(f"levenshtein(x, y, {n})") >= 0 for n in (f"least(most, {FEW})", "most"))
        return both.withColumn("most", most).filter(in_place | few | exact).select(*pairs.columns)

    label = bucket_components(buckets, near, verify)
    grouped = distinct.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = grouped.groupBy("component").agg(
        F.min("first").alias("stays"), F.sum("times").alias("all"), F.count("*").alias("kinds")
    )
    # Only groups of several lines remove any.
    several = grouped.join(heads.filter("all > 1"), "component").select("k1", "k2", "stays")
    gone = lines.select("doc_id", "tid", "pos", "k1", "k2").join(several, ["k1", "k2"])
    removed = written(
        gone.filter(~where.eqNullSafe(F.col("stays")))
        .groupBy("doc_id", "tid")
        .agg(F.sort_array(F.collect_set("pos")).alias("removed")),
        "removed",
    )
    for done in (lines, distinct, met, buckets, wanted, texts):
        dropped(done)
    return removed


def with_lines_removed(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """docs with the redundant lines cut out of text (and n_chars, if there, counted anew).

    Every row stays, but a text that loses its last such line goes if
    keep_emptied is false: all it said stays elsewhere. Null and empty texts stay
    as they are, lines without a word are never removed. Rows that repeat doc_id and text
    are cut alike, and count as one place of a line; a null doc_id is an id like any other.
    Other columns are kept, whatever their names. An empty table gives no rows.
    """
    gone = repeated_lines(docs.select("doc_id", "text")).toDF(*_GONE)
    tid, keys = F.xxhash64(docs["text"]), ["doc_id", "gone_text_tid_"]
    rows = docs.withColumn("gone_text_tid_", tid)
    lost = gone.select(*_GONE[:2])
    touched, untouched = possible(rows, keys, lost), impossible(rows, keys, lost)
    same = touched["doc_id"].eqNullSafe(F.col(_GONE[0])) & (touched["gone_text_tid_"] == F.col(_GONE[1]))
    gone_at = F.col(_GONE[2])
    left = F.filter(F.split(touched["text"], "\n"), lambda x, i: ~F.array_contains(gone_at, i))
    text = F.when(gone_at.isNull(), touched["text"]).otherwise(F.array_join(left, "\n"))
    joined = touched.join(gone, same, "left")
    if not keep_emptied:
        joined = joined.filter(gone_at.isNull() | F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    columns = {c: touched[c] for c in docs.columns}
    columns["text"] = text
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(gone_at.isNull(), touched["n_chars"]).otherwise(F.length(text).cast(kind))
    cut = joined.select(*[value.alias(name) for name, value in columns.items()])
    return cut.unionByName(untouched.select(*[untouched[c] for c in docs.columns]))


_GONE = ("gone_doc_id_", "gone_tid_", "gone_pos_")


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row of docs(doc_id, text).

    n_lines counts the lines with a word, removed has the positions of those that go.
    """
    gone = repeated_lines(docs).toDF("gone_doc_id", "gone_tid", "gone")
    worded = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("tid"), F.coalesce(worded, F.lit(0)).cast("long").alias("n_lines")
    )
    none = F.array().cast("array<int>")
    return rows.join(
        gone, rows["doc_id"].eqNullSafe(gone["gone_doc_id"]) & (rows["tid"] == gone["gone_tid"]), "left"
    ).select(
        "doc_id",
        F.greatest("n_lines", F.lit(0).cast("long")).alias("n_lines"),
        F.size(F.coalesce("gone", none)).cast("long").alias("n_removed"),
        F.coalesce("gone", none).alias("removed"),
    )
