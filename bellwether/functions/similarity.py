"""Edit ratio of two strings in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Positions of the shorter string that fit in a bigint with room for a carry.
BITS = 62


def _letters(text: Column) -> Column:
    return F.split(text, "")


def _by_bits(short: Column, long: Column) -> Column:
    """Common subsequence length by bit vectors, one step per letter of `long`.

    Bit i of the state is cleared once position i of `short` ends a longer common
    subsequence (Hyyro, 2004); the cleared bits count its length.
    """
    size = F.length(short)
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), size) - 1
    places = F.transform(
        _letters(short),
        lambda letter, at: F.struct(
            letter.alias("letter"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), at).alias("bit"),
        ),
    )

    def step(state: Column, letter: Column) -> Column:
        hits = F.aggregate(
            places,
            F.lit(0).cast("bigint"),
            lambda mask, place: F.when(
                place["letter"] == letter, mask.bitwiseOR(place["bit"])
            ).otherwise(mask),
        )

        def carry(mask: Column) -> Column:
            moved = state + state.bitwiseAND(mask)
            kept = state.bitwiseAND(F.bitwise_not(mask))
            return moved.bitwiseOR(kept).bitwiseAND(full)

        return F.get(F.transform(F.array(hits), carry), 0)

    state = F.aggregate(_letters(long), full, step)
    return (size - F.bit_count(state)).cast("int")


def _by_rows(short: Column, long: Column) -> Column:
    """The same by dynamic programming rows, for any length."""
    steps = F.transform(
        _letters(short),
        lambda letter, at: F.struct(letter.alias("letter"), at.alias("at")),
    )

    def next_row(row: Column, letter: Column) -> Column:
        def cell(done: Column, step: Column) -> Column:
            diagonal = F.get(row, step["at"])
            above = F.get(row, step["at"] + 1)
            left = F.get(done, step["at"])
            value = F.when(step["letter"] == letter, diagonal + 1).otherwise(
                F.greatest(above, left)
            )
            return F.concat(done, F.array(value))

        return F.aggregate(steps, F.array(F.lit(0)), cell)

    first_row = F.array_repeat(F.lit(0), F.length(short) + 1)
    last_row = F.aggregate(_letters(long), first_row, next_row)
    return F.element_at(last_row, -1)


def common_subsequence_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two non-empty strings."""
    in_order = F.length(a) <= F.length(b)
    short, long = F.when(in_order, a).otherwise(b), F.when(in_order, b).otherwise(a)
    return (
        F.when(a == b, F.length(a))
        .when(F.length(short) <= BITS, _by_bits(short, long))
        .otherwise(_by_rows(short, long))
    )


def edit_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (len a + len b): 100 for equal strings, 0 when one is empty."""
    total = F.length(a) + F.length(b)
    ratio = F.lit(200.0) * common_subsequence_length(a, b) / total
    return F.when((F.length(a) > 0) & (F.length(b) > 0), ratio).otherwise(F.lit(0.0))
