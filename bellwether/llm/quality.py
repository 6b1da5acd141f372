"""Quality rules: figures of each text, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.llm.scratch import bounded_batches, written
from bellwether.llm.words import hashed, mixed, seed, shingle_hashes, slices, split_words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# A line is common on a host if more documents than both limits hold it.
COMMON_DOCUMENTS, COMMON_SHARE = 5, 0.002
MAX_REMOVED_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[starts[1:]] - sums[starts[:-1]]


def repeated_words(codes: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    if len(codes) < 3:
        return 0
    windows = shingle_hashes(mixed(codes.astype(np.uint64)), 3)
    _, group, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = times[group] > 1
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def normalised_lines(lines: pa.Array) -> pa.Array:
    """A-Z lower-cased, digits as 0, runs of white space as one blank, none at the ends."""
    lines = pc.replace_substring_regex(pc.ascii_lower(lines), "[0-9]", "0")
    return pc.replace_substring_regex(pc.ascii_trim_whitespace(lines), r"[\x20\x09-\x0D]+", " ")


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    codes, starts, words = split_words(texts)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    symbols = pc.count_substring_regex(words, SYMBOLS).to_numpy(zero_copy_only=False)

    split = pc.split_pattern(texts, "\n")
    edges = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.dictionary_encode()
    line_codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_words = pc.count_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]+").to_numpy(zero_copy_only=False)
    keys = hashed(normalised_lines(coded.dictionary))
    rows: list[list] = [[], [], [], [], [], []]
    for i in range(len(texts)):
        own = line_codes[edges[i] : edges[i + 1]]
        worded = np.flatnonzero(line_words[own] > 0)
        own = own[worded]
        rows[0].append(len(own) - len(np.unique(own)))
        rows[1].append(repeated_words(codes[starts[i] : starts[i + 1]]))
        lines, place = np.unique(keys[own], return_inverse=True)
        rows[2].append(lines.view(np.int64))
        rows[3].append(np.bincount(place, weights=line_words[own], minlength=len(lines)).astype(np.int64))
        rows[5].append(np.split(worded[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place))[:-1]))
        rows[4].append(int(mixed(keys[own] + seed(3)).sum(dtype=np.uint64) >> np.uint64(1)))
    long_list = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("source"),
            pa.array(np.diff(starts)),
            pa.array(_per_text(chars[codes], starts)),
            pa.array(_per_text(symbols[codes], starts)),
            pa.array(rows[0], pa.int64()),
            pa.array(rows[1], pa.int64()),
            pa.array(rows[2], long_list),
            pa.array(rows[3], long_list),
            pa.array(rows[5], pa.list_(pa.list_(pa.int32()))),
            pa.array(rows[4], pa.int64()),
            batch.column("tid"),
        ],
        list(_SCHEMA),
    )


_SCHEMA = {
    "doc_id": "long",
    "source": "string",
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "lines": "array<long>",
    "line_words": "array<long>",
    "line_places": "array<array<int>>",
    "content": "long",
    "tid": "long",
}


_FIGURES = (
    "doc_id",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_common_words",
    "base_failed",
    "kept",
)


def judged(docs: DataFrame) -> DataFrame:
    """Figures and verdict of every row of docs(doc_id, text, source), plus tid, source and cut.

    tid is a hash of the text, cut has the positions (from 0, between line feeds) of
    its lines that are common on its host. The figures are those of quality().
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _features(part)

    found = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("tid")).mapInArrow(
        run, ", ".join(f"{name} {kind}" for name, kind in _SCHEMA.items())
    )
    table = written(found.withColumn("row", F.monotonically_increasing_id()), "features")
    contents = table.groupBy("source", "content").agg(F.min("row").alias("row"))
    hosts = contents.groupBy("source").agg(F.count("*").alias("documents"))
    limit = F.greatest(F.lit(float(COMMON_DOCUMENTS)), F.col("documents") * COMMON_SHARE)
    line = F.explode("lines").alias("line")
    held = (
        table.select("source", "row", "lines")
        .join(contents.select("row"), "row", "left_semi")
        .select("source", line)
        .groupBy("source", "line")
        .agg(F.count("*").alias("times"))
        .filter(F.col("times") > COMMON_DOCUMENTS)
    )
    common = (
        held.alias("l")
        .join(hosts.alias("h"), F.col("l.source").eqNullSafe(F.col("h.source")))
        .filter(F.col("times") > limit)
        .select(F.col("l.source").alias("host"), F.col("line").alias("common"))
    )
    zipped = table.select("source", "row", F.inline(F.arrays_zip("lines", "line_words", "line_places")))
    removed = (
        zipped.join(common, F.col("source").eqNullSafe(F.col("host")) & (F.col("lines") == F.col("common")))
        .groupBy("row")
        .agg(
            F.sum("line_words").alias("removed"),
            F.sort_array(F.flatten(F.collect_list("line_places"))).alias("cut"),
        )
    )
    n_common = F.coalesce("removed", F.lit(0)).cast("long")
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        table.drop("lines", "line_words", "line_places", "content")
        .join(removed, "row", "left")
        .withColumns({"n_common_words": n_common, "base_failed": base_failed})
        .withColumn("cut", F.coalesce("cut", F.array().cast("array<int>")))
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (100 * F.col("n_common_words") <= MAX_REMOVED_PERCENT * F.col("n_words")),
        )
        .select(*_FIGURES, "tid", "source", "cut")
    )


def quality(docs: DataFrame) -> DataFrame:
    """Figures and verdict of every row of docs(doc_id, text, source).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier one) and n_repeat_words (words in
    three-word windows found twice) describe the whole text; base_failed is
    fewer than 50 words or more than half of them repeated.

    Lines are normalised and hashed. A line is common on a host (the source)
    if more than COMMON_DOCUMENTS documents and more than COMMON_SHARE of the host's
    documents of different lines hold it; copies of one document count once.
    n_common_words are the words on such lines, and a document with more than half
    of its words there is depleted. kept is false if base_failed or depleted.
    with_common_lines_removed() gives the kept documents without these lines.

    Null and empty texts have no words and fail; a null source is a host; a null
    or repeated doc_id is returned as it is. An empty table gives no rows; other
    columns are ignored.
    """
    return judged(docs).select(*_FIGURES)


_VERDICT = ("quality_doc_id_", "quality_tid_", "quality_source_", "quality_cut_")


def with_common_lines_removed(docs: DataFrame) -> DataFrame:
    """The kept rows of docs with the lines that are common on their host cut out of text.

    n_chars, if there, is counted anew where lines went. Rows that repeat doc_id, text
    and source all stay. Other columns are kept, whatever their names.
    """
    kept = judged(docs).filter("kept").select("doc_id", "tid", "source", "cut").toDF(*_VERDICT)
    # Rows of equal doc_id, text and source have equal verdicts.
    verdicts = kept.groupBy(*_VERDICT[:3]).agg(F.first(_VERDICT[3]).alias(_VERDICT[3]))
    of_id, of_tid, of_source, cut = (F.col(c) for c in _VERDICT)
    same = docs["doc_id"].eqNullSafe(of_id) & docs["source"].eqNullSafe(of_source)
    joined = docs.join(verdicts, same & (F.xxhash64(docs["text"]) == of_tid))
    left = F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(cut, i))
    text = F.when(F.size(cut) == 0, docs["text"]).otherwise(F.array_join(left, "\n"))
    columns = {c: docs[c] for c in docs.columns}
    columns["text"] = text
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.size(cut) == 0, docs["n_chars"]).otherwise(F.length(text).cast(kind))
    return joined.select(*[value.alias(name) for name, value in columns.items()])
