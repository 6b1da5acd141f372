"""A text classifier of sentiment: hashed words, one softmax model fitted over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.functions.text import word_tokens
from bellwether.operators.fitting import climbed, summed
from bellwether.operators.sentiment import LABELS, word_sums
from bellwether.sources.steps import stored

BUCKETS = 1 << 14  # cells that words are hashed into
FIT_TEXTS = 20_000  # labelled texts of the fit, at most
PASSES, SHRINK = 40, 3e-4


def buckets(text: Column) -> Column:
    """The different cells of the words of a text, in no order; a text without a word has none."""
    cells = F.transform(word_tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return F.coalesce(F.array_distinct(cells), F.array().cast("array<int>"))


def held_out(key: Column) -> Column:
    """Whether a fifth of the keys, by a hash that any engine has, is kept for the test."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 5 == 0


def slope_of(cells: pa.ListArray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient of the log likelihood by weights (BUCKETS + 1 rows, the last for no cell), and the number of texts.

    A text has 1 / sqrt(n) in each of its n cells, and 1 in the last row.
    """
    sizes = np.diff(cells.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    cell = cells.flatten().to_numpy()
    value = 1 / np.sqrt(np.maximum(sizes, 1))
    k = weights.shape[1]
    scores = np.stack([np.bincount(row, weights[cell, c], len(sizes)) for c in range(k)], axis=1)
    scores = scores * value[:, None] + weights[-1]
    scores -= scores.max(axis=1, keepdims=True)
    share = np.exp(scores)
    share /= share.sum(axis=1, keepdims=True)
    left = -share
    left[np.arange(len(labels)), labels] += 1
    slope = np.zeros_like(weights)
    for c in range(k):
        slope[:-1, c] = np.bincount(cell, (left[:, c] * value)[row], BUCKETS)
    slope[-1] = left.sum(axis=0)
    return np.append(slope.ravel(), len(labels))


def fit(texts: DataFrame, passes: int = PASSES) -> np.ndarray | None:
    """Weights (BUCKETS + 1, labels) of a softmax model, None without a labelled text.

    texts has (text, sentiment); the FIT_TEXTS with the smallest digests are used. The sample is
    written once; every pass sums its gradient over the partitions.
    """
    labelled = texts.filter(F.col("sentiment").isin(LABELS) & F.col("text").isNotNull())
    ordered = labelled.select(F.md5("text").alias("digest"), "sentiment", buckets(F.col("text")).alias("cells"))
    place = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("sentiment")).cast("int") - 1
    chosen = ordered.orderBy("digest", "sentiment").limit(FIT_TEXTS).select("cells", place.alias("label"))
    sample = stored(chosen, "labelled")
    shape = (BUCKETS + 1, len(LABELS))

    def slope(flat: np.ndarray) -> np.ndarray:
        weights = flat.reshape(shape)

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for batch in batches:
                own = slope_of(batch.column("cells"), batch.column("label").to_numpy(), weights)
                total = own if total is None else total + own
            return total

        found = summed(sample, part)
        return found[:-1] / found[-1] - SHRINK * flat if found is not None else np.full(flat.shape, np.nan)

    if sample.isEmpty():
        return None
    return climbed(np.zeros(shape[0] * shape[1]), slope, passes).reshape(shape)


def weight_rows(spark: SparkSession, weights: np.ndarray | None) -> tuple[DataFrame, list[float]]:
    """(cell, weights) of every cell, and the weights of a text without cells; zeros where there is no fit."""
    if weights is None:
        weights = np.zeros((BUCKETS + 1, len(LABELS)))
    names = [f"w{c}" for c in range(len(LABELS))]
    columns = {"cell": np.arange(BUCKETS, dtype=np.int32)} | {n: weights[:-1, c] for c, n in enumerate(names)}
    return spark.createDataFrame(pa.table(columns)), [float(x) for x in weights[-1]]


def classified(texts: DataFrame, weights: np.ndarray | None, key: str, text: str = "text") -> DataFrame:
    """(key, sentiment, confidence): the likeliest label of every text and its probability.

    Blank and null texts are neutral with confidence 0. The weights are BUCKETS rows, so they
    are broadcast; the sums are complete in the task that reads a text.
    """
    table, bare = weight_rows(texts.sparkSession, weights)
    names = table.columns[1:]
    cells = texts.select(key, F.explode_outer(buckets(F.col(text))).alias("cell"))
    sums = word_sums(cells, key, table, "cell", names)
    size = F.sqrt(F.greatest("words", F.lit(1)).cast("double"))
    scored = sums.select(key, "words", F.array(*[F.col(n) / size + F.lit(b) for n, b in zip(names, bare)]).alias("s"))
    top = F.array_max("s")
    total = F.aggregate("s", F.lit(0.0), lambda sofar, x: sofar + F.exp(x - top))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("s", top).cast("int"))
    blank = F.col("words") < 1
    return scored.select(
        key,
        F.when(blank, F.lit("neutral")).otherwise(label).alias("sentiment"),
        F.when(blank, F.lit(0.0)).otherwise(1 / total).alias("confidence"),
    )


def accuracy(told: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """(documents, accuracy) of told(key, sentiment) on labelled(key, sentiment), as one row."""
    both = labelled.select(key, F.col("sentiment").alias("wanted")).join(told.select(key, "sentiment"), key)
    right = (F.col("sentiment") == F.col("wanted")).cast("double")
    return both.agg(F.count("*").alias("documents"), F.avg(right).alias("accuracy"))
