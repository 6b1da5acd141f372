"""The operators of this folder as named queries over the whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.llm.exact_search import nearest, quantised
from bellwether.llm.language import identify, page_evidence
from bellwether.llm.line_dedup import line_report
from bellwether.llm.mixing import mixed_sources
from bellwether.llm.near_dedup import near_duplicates
from bellwether.llm.packing import packed_documents
from bellwether.llm.passages import repeated_passages
from bellwether.llm.periodic_runs import periodic_runs, run_report, with_repeats
from bellwether.llm.personal_data import personal_data, span_report
from bellwether.llm.quality import quality
from bellwether.llm.scratch import new_path
from bellwether.llm.token_alignment import aligned_documents, pair_counts, scores
from bellwether.llm.token_files import checksums, token_files, write_tokens
from bellwether.llm.toxicity import toxicity

TOKENIZERS = os.environ.get("BELLWETHER_TOKENIZERS")


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in the folder BELLWETHER_TOKENIZERS, else the installed one."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85).drop("tid")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity(_table(spark, sf_dir, "documents"), labels)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_evidence(_table(spark, sf_dir, "pages"))
    return identify(_table(spark, sf_dir, "documents"), pages).drop("tid")


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return checksums(token_files(spark, folder))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", quantised("embedding").alias("v"))
    return nearest(rows, F.col("vec_id") % 50 == 0)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts without tokens have an empty column in place of a digest.
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    documents, index = aligned_documents(
        _table(spark, sf_dir, "documents"),
        tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"),
        {"groups_sha256": digest},
    )
    found = scores(documents, index, pair_counts(index))
    figures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return found.select("doc_id", *figures, "groups_sha256")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(personal_data(_table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(with_repeats(_table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_entropy_mixing": op6_entropy_mixing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_files": op9_token_files,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_personal_data": op12_personal_data,
    "op13_periodic_runs": op13_periodic_runs,
}
