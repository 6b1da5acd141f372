"""A bitmap of fixed size that tells which rows can have a partner, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 25  # bits, 4 MB whatever the input
PAGE = 1 << 15  # bits of a row of the bitmap, as Spark's bitmap functions have them


def _slot(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


def marked(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """rows plus maybe: false where no row of keys can equal it in columns.

    keys has the same number of columns, in order and of the same types; nulls
    equal nulls. The bitmap is broadcast, 4 MB at most, so the rows stay where
    they are. The more keys there are, the more rows are let through in vain.
    """
    slot = _slot(*keys.columns)
    pages = (
        keys.select(F.floor(slot / PAGE).alias("page_of_bits"), F.pmod(slot, F.lit(PAGE)).alias("bit"))
        .groupBy("page_of_bits")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    own = _slot(*[rows[c] for c in columns])
    bit = F.pmod(own, F.lit(PAGE))
    byte = F.conv(F.hex(F.substring(pages["bits"], (F.floor(bit / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    # The mask of the bit within its byte.
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.pmod(bit, F.lit(8)) + 1).cast("int"))
    joined = rows.join(F.broadcast(pages), F.floor(own / PAGE) == pages["page_of_bits"], "left")
    maybe = F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))
    return joined.select(*[rows[c] for c in rows.columns], maybe.alias("maybe_in_keys"))


def possible(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """The rows that may have a partner in keys."""
    return marked(rows, columns, keys).filter("maybe_in_keys").drop("maybe_in_keys")


def impossible(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """The rows that have no partner in keys for sure: those possible() leaves out."""
    return marked(rows, columns, keys).filter("not maybe_in_keys").drop("maybe_in_keys")
