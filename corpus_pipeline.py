"""A corpus pipeline: every stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.llm.language import identify, page_evidence
from bellwether.llm.line_dedup import with_lines_removed
from bellwether.llm.membership import impossible, possible
from bellwether.llm.mixing import taken_documents
from bellwether.llm.near_dedup import near_duplicates
from bellwether.llm.packing import packed_documents
from bellwether.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Rows of docs that no verdict (of_id, of_tid, ...) is about for sure, the others, and what joins those.

    A verdict is about a text of a document. Only rows that may have one are shuffled.
    """
    rows, keys = docs.withColumn("of_text_tid", F.xxhash64("text")), ["doc_id", "of_text_tid"]
    names = verdicts.select("of_id", "of_tid")
    free, judged = impossible(rows, keys, names), possible(rows, keys, names)
    same = judged["doc_id"].eqNullSafe(verdicts["of_id"]) & (judged["of_text_tid"] == verdicts["of_tid"])
    return free.drop("of_text_tid"), judged, same


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that text, declarations, address and host make sure."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = identify(docs, page_evidence(pages))
    rejected = found.filter("not kept").select(F.col("doc_id").alias("of_id"), F.col("tid").alias("of_tid"))
    rejected = written(rejected.distinct(), "rejected")
    free, judged, same = _apart(docs, rejected)
    return free.unionByName(judged.join(rejected, same, "left_anti").drop("of_text_tid"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line makes redundant; one that has no other lines goes."""
    return with_lines_removed(docs, keep_emptied=False)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Rows that repeat doc_id and text are one document, so one of them stays.
    """
    found = near_duplicates(docs, k=5, percent=80)
    rows = found.groupBy(F.col("doc_id").alias("of_id"), F.col("tid").alias("of_tid")).agg(
        F.min("kept").alias("of_kept"), F.count("*").alias("of_rows")
    )
    marked = written(rows.filter("not of_kept or of_rows > 1"), "marked")
    free, judged, same = _apart(docs, marked)
    judged = judged.join(marked, same, "left").filter("of_kept is null or of_kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = judged.filter("of_rows is null or of_rows = 1").select(*columns)
    several = judged.filter("of_rows > 1").dropDuplicates(["of_id", "of_tid"]).select(*columns)
    return free.unionByName(single).unionByName(several)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return taken_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every copy."""
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("entropy_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# SimHash, Newton steps and best fit have no SQL form; tests hold the rows
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        if place:
            docs = written(docs, name)
        docs = stage(spark, docs, sf_dir)
    return docs
