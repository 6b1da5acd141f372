"""Age and exponential decay of mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS_RATE = 1e-5  # half-life 19.3 h when ages are in seconds
HOURS_RATE = 0.01  # half-life 69.3 h when ages are in hours

_UNIT_SECONDS = {"seconds": 1.0, "hours": 3600.0}


def age_seconds(timestamp: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(timestamp)) / F.lit(1e6)


def decay(
    timestamp: Column, as_of: Column, rate: float = SECONDS_RATE, unit: str = "seconds"
) -> Column:
    """exp(-rate * age); a missing timestamp weighs 0."""
    age = age_seconds(timestamp, as_of) / F.lit(_UNIT_SECONDS[unit])
    return F.coalesce(F.exp(F.lit(-rate) * age), F.lit(0.0))


def reference_time(df: DataFrame, column: str = "timestamp") -> Column:
    """Latest timestamp of df as a scalar subquery, now when there is none."""
    return F.coalesce(df.agg(F.max(column)).scalar(), F.current_timestamp())


def as_of_column(df: DataFrame, as_of, column: str = "timestamp") -> Column:
    """A given moment (literal or Column), else the latest timestamp of df."""
    if as_of is None:
        return reference_time(df, column)
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")
