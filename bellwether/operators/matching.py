"""Joins of similar names without comparing all pairs.

Two names with at most t insertions and deletions between them share at least one
of the t + 1 pieces one of them is cut into, at nearly the same place. So pieces are
joined by equality and only names that share one are compared. No pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions.similarity import common_subsequence_length, edit_ratio

LOWEST_BOUND = 70.0


def _budget(one: str, other: str, slack: float) -> Column:
    """Most edits a pair of these lengths may have to stay above the bound.

    Insertions plus deletions have the parity of the length sum.
    """
    most = F.ceil(F.lit(slack) * (F.col(one) + F.col(other))) - 1
    return (most - F.pmod(most + F.col(one) + F.col(other), F.lit(2))).cast("int")


def _with_partner_lengths(names: DataFrame, own: str, partner: str, slack: float):
    low, high = (1 - slack) / (1 + slack), (1 + slack) / (1 - slack)
    lengths = F.sequence(
        F.greatest(F.ceil(F.col(own) * low), F.lit(1)).cast("int"),
        F.greatest(F.floor(F.col(own) * high), F.lit(1)).cast("int"),
    )
    return (
        names.withColumn(partner, F.explode(lengths))
        .withColumn("budget", _budget("left_length", "right_length", slack))
        .filter(F.col("budget") >= F.abs(F.col("left_length") - F.col("right_length")))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("budget"))))
        .withColumn("start", F.expr("int(part * left_length div (budget + 1))"))
        .withColumn("stop", F.expr("int((part + 1) * left_length div (budget + 1))"))
    )


_KEY = ["left_length", "right_length", "part", "piece"]


def similar_pairs(
    left: DataFrame, right: DataFrame, bound: float, left_col: str, right_col: str
) -> DataFrame:
    """Pairs of names with an edit ratio above bound, as (left, right, ratio).

    Both sides hold distinct non-empty names. The left (usually larger) side is cut
    into pieces, one row per piece; the right side lists its substrings at the
    places an allowed shift can reach.
    """
    if bound < LOWEST_BOUND:
        raise ValueError(f"bound must be at least {LOWEST_BOUND}")
    slack = 1 - bound / 100
    cut = _with_partner_lengths(
        left.select(F.col(left_col).alias("left")).withColumn(
            "left_length", F.length("left")
        ),
        "left_length",
        "right_length",
        slack,
    ).withColumn("piece", F.expr("substring(left, start + 1, stop - start)"))

    reach = _with_partner_lengths(
        right.select(F.col(right_col).alias("right")).withColumn(
            "right_length", F.length("right")
        ),
        "right_length",
        "left_length",
        slack,
    )
    shifts = F.expr(
        "sequence((right_length - left_length - budget) div 2, "
        "(right_length - left_length + budget) div 2)"
    )
    listed = (
        reach.withColumn("shift", F.explode(shifts))
        .filter(
            (F.col("start") + F.col("shift") >= 0)
            & (F.col("stop") + F.col("shift") <= F.col("right_length"))
        )
        .withColumn("piece", F.expr("substring(right, start + shift + 1, stop - start)"))
        .select(*_KEY, "right")
        .distinct()
    )
    near = F.expr("levenshtein(left, right, budget) >= 0")
    # Sizes after exploding are not known when the join is planned: always shuffle
    # (the adaptive skew join splits a piece many names share), never broadcast.
    return (
        cut.select(*_KEY, "left", "budget")
        .join(listed.hint("merge"), _KEY)
        .filter(near)
        .select("left", "right")
        .distinct()
        .withColumn("ratio", edit_ratio(F.col("left"), F.col("right")))
        .filter(F.col("ratio") > bound)
        .select(F.col("left").alias(left_col), F.col("right").alias(right_col), "ratio")
    )


def _token_set(name: str) -> Column:
    return F.array_distinct(F.split(F.col(name), " "))


def rarest_words(words: DataFrame, name: str, others: DataFrame) -> DataFrame:
    """words(name, word) cut to the word of each name that makes the fewest pairs with others(word).

    A word makes as many pairs as names times others hold it; both are counted, so
    a long word that all names share is no key. A word that no other holds makes
    none, whatever the name. Ties go to the alphabetically first word.
    """
    names = words.groupBy("word").agg(F.count("*").alias("n_names"))
    held = others.groupBy("word").agg(F.count("*").alias("n_others"))
    cost = F.col("n_names") * F.coalesce("n_others", F.lit(0))
    counted = words.join(names.join(held, "word", "left").select("word", cost.alias("cost")), "word")
    return counted.groupBy(name).agg(F.min(F.struct("cost", "word"))["word"].alias("word"))


def containing_pairs(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str
) -> DataFrame:
    """Pairs where the words of one name are all among the words of the other.

    Every word of the contained name must be among the other's words, so its rarest
    one is the join key; both directions are looked up.
    """
    one = left.select(F.col(left_col), _token_set(left_col).alias("left_words"))
    two = right.select(F.col(right_col), _token_set(right_col).alias("right_words"))
    left_each = one.select(left_col, F.explode("left_words").alias("word"))
    right_each = two.select(right_col, F.explode("right_words").alias("word"))
    left_inside = (
        rarest_words(left_each, left_col, right_each)
        .join(right_each, "word")
        .join(one, left_col)
        .join(two, right_col)
    )
    right_inside = (
        rarest_words(right_each, right_col, left_each)
        .join(left_each, "word")
        .join(one, left_col)
        .join(two, right_col)
    )
    contained = F.size(F.array_except("left_words", "right_words")) == 0
    contains = F.size(F.array_except("right_words", "left_words")) == 0
    return (
        left_inside.filter(contained)
        .select(left_col, right_col)
        .union(right_inside.filter(contains).select(left_col, right_col))
        .distinct()
    )


def _grams(names: DataFrame, name: str) -> DataFrame:
    """(name, gram) of the three-letter grams of a name's different words, each word between two marks.

    A gram that a name has twice counts as two: the second one is numbered.
    """
    words = F.transform(_token_set(name), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    grams = F.flatten(
        F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    )
    each = names.select(name, F.posexplode(grams).alias("at", "gram"))
    nth = F.row_number().over(Window.partitionBy(name, "gram").orderBy("at"))
    return each.select(name, F.concat_ws("|", "gram", nth).alias("gram"))


def word_set_score(a: Column, b: Column) -> Column:
    """The best of three ratios (0 to 100) of two lists of different words that share some.

    With the shared words s, and what is left of each list sorted: s with all of a against s
    with all of b, s against s with all of a, and s against s with all of b.
    """

    def joined(words: Column) -> Column:
        return F.array_join(F.array_sort(words), " ")

    shared, left, right = (joined(x) for x in (F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)))
    parts = F.struct(F.length(shared).alias("n"), left.alias("l"), right.alias("r"))

    def score(p: Column) -> Column:
        n, x, y = p["n"], F.length(p["l"]), F.length(p["r"])
        common = F.when((x > 0) & (y > 0), common_subsequence_length(p["l"], p["r"])).otherwise(0)
        whole = 2 * n + 2 + x + y
        return F.greatest(
            100 - 100.0 * (x + y - 2 * common) / whole,
            100 - 100.0 * (1 + x) / (2 * n + 1 + x),
            100 - 100.0 * (1 + y) / (2 * n + 1 + y),
        )

    # One-element transform: words are compared once per pair.
    return F.get(F.transform(F.array(parts), score), 0)


def overlapping_pairs(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str, bound: float
) -> DataFrame:
    """Pairs of names that share some but not all words of either, as (left, right, score) above bound.

    A set-similarity join. With e = 1 - bound / 100, a pair above the bound by its whole lists has
    at most e / (1 - e) of a list's letters in edits, each of which spoils three grams; one
    above it by one list against the shared words has no more letters of that list outside of
    them. So of a name's grams in the order of their frequency, the first ones (three times the
    most edits, and one) hold one that the partner has too, and behind the first gram they
    share there are enough left on both sides. Only such pairs are scored; none is lost.
    """
    slack = 1 - bound / 100
    share = F.lit(2 * slack / (1 - slack) + 1e-9)
    # A pair needs a name long enough for one edit, and one of two thirds its length at least.
    one, two = (
        _grams(names.filter(share * 1.5 * F.length(name) >= 1), name)
        for names, name in ((left, left_col), (right, right_col))
    )
    total = one.select("gram").union(two.select("gram")).groupBy("gram").agg(F.count("*").alias("times"))

    def ordered(grams: DataFrame, name: str, own: str) -> DataFrame:
        by_name = Window.partitionBy(name)
        letters = F.aggregate(_token_set(name), F.lit(-1), lambda n, w: n + F.length(w) + 1)
        edits = F.floor(share * letters).cast("int")
        return (
            grams.join(total, "gram")
            .withColumn("place", F.row_number().over(by_name.orderBy("times", "gram")))
            .withColumn("size", F.count("*").over(by_name))
            .select(
                name, "gram", *[F.col(c).alias(f"{own}_{c}") for c in ("place", "size")], edits.alias(f"{own}_edits")
            )
        )

    a, b = ordered(one, left_col, "a"), ordered(two, right_col, "b")

    def met(first: DataFrame, second: DataFrame, own: str, other: str) -> DataFrame:
        spoilt = 3 * F.col(f"{own}_edits")
        leading = first.filter((F.col(f"{own}_edits") > 0) & (F.col(f"{own}_place") <= spoilt + 1))
        rest = [F.col(f"{x}_size") - F.col(f"{x}_place") + 1 for x in (own, other)]
        enough = F.least(*rest) >= F.col(f"{own}_size") - spoilt
        return leading.join(second, "gram").filter(enough).select(left_col, right_col)

    pairs = met(a, b, "a", "b").union(met(b, a, "b", "a")).distinct()
    long, short = (
        F.greatest(F.length(left_col), F.length(right_col)),
        F.least(F.length(left_col), F.length(right_col)),
    )
    words = [_token_set(left_col), _token_set(right_col)]
    part = (
        (F.size(F.array_intersect(*words)) > 0)
        & (F.size(F.array_except(*words)) > 0)
        & (F.size(F.array_except(*words[::-1])) > 0)
    )
    return (
        pairs.filter((long * 2 < short * 3) & part)
        .withColumn("score", word_set_score(*words))
        .filter(F.col("score") > bound)
    )


GRAM = 3  # letters of the keys of contained names


def substring_pairs(inner: DataFrame, outer: DataFrame, inner_col: str, outer_col: str) -> DataFrame:
    """Pairs where a name of inner stands in a longer name of outer, as (inner, outer).

    Every gram of GRAM letters of the inner name (the whole name if shorter) stands in the outer
    one, so its rarest gram is the key; a name has as many grams as letters.
    """

    def pieces(name: str, size: Column) -> Column:
        return F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substr(F.col(name), i, size))
        )

    own = F.least(F.length(inner_col), F.lit(GRAM))
    inside = inner.filter(F.length(inner_col) > 0).select(inner_col, F.explode(pieces(inner_col, own)).alias("word"))
    sizes = [
        F.when(F.length(outer_col) >= n, pieces(outer_col, F.lit(n))).otherwise(F.array().cast("array<string>"))
        for n in range(1, GRAM + 1)
    ]
    around = outer.select(outer_col, F.explode(F.concat(*sizes)).alias("word"))
    stands = F.col(outer_col).contains(F.col(inner_col)) & (F.length(outer_col) > F.length(inner_col))
    return rarest_words(inside, inner_col, around).join(around, "word").filter(stands).select(inner_col, outer_col)


def rounded(score: Column) -> Column:
    """Half-even whole number, as scores are compared."""
    return F.bround(score, 0)


def best_match(pairs: DataFrame, name: str, match: str, score: Column) -> DataFrame:
    """Highest score per name, the smaller match on ties."""
    ranked = F.struct((-score).alias("cost"), F.col(match).alias("match"))
    return (
        pairs.groupBy(name)
        .agg(F.min(ranked).alias("best"))
        .select(
            name,
            F.col("best.match").alias(match),
            (-F.col("best.cost")).alias("score"),
        )
    )
