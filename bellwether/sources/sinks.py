"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Replace the table at path (parquet, or CSV with a header for export)."""
    writer = df.write.mode("overwrite")
    if csv:
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_to_all(df: DataFrame, paths: Sequence[str]) -> None:
    """One result to several tables, computed once."""
    if len(paths) == 1:
        write_table(df, paths[0])
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for path in paths:
            write_table(kept, path)
    finally:
        kept.unpersist()


def name_audit(df: DataFrame, raw: str = "company", clean: str = "normalized_company"):
    """Distinct raw -> normalised names."""
    return df.select(F.col(raw), F.col(clean)).distinct()
