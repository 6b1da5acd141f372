"""Parsing, missing values and small numeric helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_timestamp(text: Column) -> Column:
    """Parsed timestamp, NULL when the text is not one."""
    return F.try_to_timestamp(text)


def epoch_to_timestamp(seconds: Column) -> Column:
    """Timestamp of seconds since 1970, NULL when they are not a number or out of range."""
    micros = F.nanvl(seconds.try_cast("double"), F.lit(None).cast("double")) * 1e6
    return F.timestamp_micros(micros.try_cast("bigint"))


def to_number(text: Column) -> Column:
    """Number, 0 when the text is not one."""
    number = text.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def is_finite(value: Column) -> Column:
    """Neither missing nor NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def blank_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Empty strings and NaN mean missing: make both NULL."""
    wanted = set(df.columns if columns is None else columns)
    changed = {}
    for field in df.schema.fields:
        if field.name not in wanted:
            continue
        if isinstance(field.dataType, T.StringType):
            changed[field.name] = F.nullif(F.col(field.name), F.lit(""))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changed[field.name] = F.when(~F.isnan(field.name), F.col(field.name))
    return df.withColumns(changed) if changed else df


def present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def min_max(
    value: Column, low: Column, high: Column, floor: float = 0.0, ceiling: float = 1.0
) -> Column:
    """Scale value from [low, high] to [floor, ceiling]."""
    return (value - low) / (high - low) * F.lit(ceiling - floor) + F.lit(floor)


def utc_text(timestamp: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss UTC, for a session in UTC."""
    return F.concat(F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def two_decimals(value: Column) -> Column:
    """Two-decimal text, N/A when missing."""
    return F.coalesce(
        F.when(value.isNotNull(), F.format_string("%.2f", value.cast("double"))),
        F.lit("N/A"),
    )
