"""Toxicity of texts by a linear classifier that swapped identity terms must not move."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.llm.scratch import bounded_batches, written
from bellwether.llm.words import slices, split_words

# Terms for groups of people. A term is swapped for its neighbours
# in the same list.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "chinese", "mexican", "indian"),
    ("immigrant", "refugee", "native"),
    ("immigrants", "refugees", "natives"),
    ("christen", "muslime", "juden", "atheisten"),
    ("frauen", "männer"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("femmes", "hommes"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
    ("mujeres", "hombres"),
)

SAMPLE_ROWS = 10_000  # labelled rows of each class that the fit reads, at most
FEATURES = 2048  # features that the classifier weighs
MIN_TEXTS = 3  # sampled texts that hold a feature, at least
RIDGE = 1.0
FAIRNESS = 10.0  # weight of a squared score change under a swap
PREFIXES = (4, 5)
_NOT_ALNUM = r"[^\pL\pN]+"
_SENTENCE = re.compile(r"[.!?\n]+")


def _swaps() -> dict[str, tuple[str, ...]]:
    out = {}
    for terms in IDENTITY_TERMS:
        for i, term in enumerate(terms):
            out[term] = tuple(dict.fromkeys((terms[i - 1], terms[(i + 1) % len(terms)])))
    return out


SWAPS = _swaps()


def word_features(words: pa.Array) -> np.ndarray:
    """A row of hashed features per word: the word in lower case and its beginnings; 0 for none."""
    plain = pc.replace_substring_regex(pc.utf8_lower(words), _NOT_ALNUM, "")
    columns = [_feature_hash(plain, "whole")]
    for size in PREFIXES:
        start = pc.utf8_slice_codeunits(plain, 0, size)
        hashes = _feature_hash(start, f"first-{size}")
        hashes[pc.utf8_length(plain).to_numpy(zero_copy_only=False) < size] = 0
        columns.append(hashes)
    table = np.stack(columns, axis=1) if len(plain) else np.zeros((0, 1 + len(PREFIXES)), np.int64)
    table[pc.utf8_length(plain).to_numpy(zero_copy_only=False) == 0] = 0
    return table


def _feature_hash(strings: pa.Array, kind: str) -> np.ndarray:
    found = pd.util.hash_array(
        strings.to_numpy(zero_copy_only=False).astype(object), hash_key=f"{kind:<16}", categorize=False
    )
    return (found >> np.uint64(1)).astype(np.int64)


def _present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of the texts, in order."""
    codes, starts, words = split_words(texts)
    features = word_features(words)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = np.unique(np.stack((text, codes)), axis=1) if len(codes) else np.zeros((2, 0), np.int64)
    text = np.repeat(pairs[0], features.shape[1])
    feature = features[pairs[1]].ravel()
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    new &= feature != 0
    return text[new], feature[new]


def _lists(rows: int, text: np.ndarray, values: pa.Array) -> pa.ListArray:
    ends = np.searchsorted(text, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def features_of(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, features): the distinct hashed features of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, feature = _present(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), _lists(part.num_rows, text, pa.array(feature))],
                    ["doc_id", "toxic", "features"],
                )

    return sample.select("doc_id", "toxic", "text").mapInArrow(
        run, "doc_id long, toxic int, features array<long>"
    )


def swapped_sentences(text: str) -> Iterator[tuple[str, str]]:
    """(sentence, the sentence with one identity term swapped), whole text."""
    for sentence in _SENTENCE.split(text):
        words = sentence.split()
        plain = [re.sub(r"\W+", "", w.lower()) for w in words]
        for i, word in enumerate(plain):
            for other in SWAPS.get(word, ()):
                yield sentence, " ".join([*words[:i], other, *words[i + 1 :]])


def counterfactuals(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(plus, minus, times): chosen features that a swap brings and takes, over all labelled sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for text in batch.column("text"):
                pairs = list(swapped_sentences(text.as_py() or ""))
                if not pairs:
                    continue
                row, feature = _present(pa.array([s for pair in pairs for s in pair]))
                known = np.isin(feature, chosen)
                row, place = row[known], np.searchsorted(chosen, feature[known])
                for i in range(len(pairs)):
                    before, after = (set(place[row == j].tolist()) for j in (2 * i, 2 * i + 1))
                    key = (tuple(sorted(after - before)), tuple(sorted(before - after)))
                    if key != ((), ()):
                        counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([list(k[0]) for k in counts], pa.list_(pa.int32())),
                    pa.array([list(k[1]) for k in counts], pa.list_(pa.int32())),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["plus", "minus", "times"],
            )

    found = sample.select("text").mapInArrow(run, "plus array<int>, minus array<int>, times long")
    return found.groupBy("plus", "minus").agg(F.sum("times").alias("times"))


def _product(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, vector: np.ndarray) -> np.ndarray:
    return np.bincount(rows, weights=values * vector[columns], minlength=n)


def fit_weights(
    rows: np.ndarray,
    columns: np.ndarray,
    toxic: np.ndarray,
    weight: np.ndarray,
    swaps: list[tuple[list[int], list[int], int]],
    n_features: int,
    fairness: float = FAIRNESS,
) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the regularised logistic fit, by Newton steps with conjugate gradients.

    The loss is the weighted log loss, plus RIDGE / 2 * |w|^2, plus fairness / 2
    times the mean squared score change over all swaps.
    """
    n, ones = len(toxic), np.ones(len(rows))
    change_row = np.array([i for i, s in enumerate(swaps) for _ in (*s[0], *s[1])], np.int64)
    change_col = np.array([c for s in swaps for c in (*s[0], *s[1])], np.int64)
    change = np.array([v for s in swaps for v in [1.0] * len(s[0]) + [-1.0] * len(s[1])])
    times = np.array([float(s[2]) for s in swaps])
    # A mean over swaps, on the scale of the whole sample.
    times = times * (fairness * n / times.sum()) if len(times) else times

    def penalty(vector: np.ndarray) -> np.ndarray:
        moved = _product(change_row, change_col, change, len(swaps), vector) * times
        return RIDGE * vector + np.bincount(change_col, weights=change * moved[change_row], minlength=n_features)

    w, b = np.zeros(n_features), float(np.log(max(weight @ toxic, 1e-9) / max(weight @ (1 - toxic), 1e-9)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(_product(rows, columns, ones, n, w) + b, -30, 30)))
        error, curve = weight * (p - toxic), weight * p * (1 - p) + 1e-9
        grad = np.append(np.bincount(columns, weights=error[rows], minlength=n_features) + penalty(w), error.sum())

        def hessian(v: np.ndarray, curve: np.ndarray = curve) -> np.ndarray:
            s = curve * (_product(rows, columns, ones, n, v[:-1]) + v[-1])
            return np.append(np.bincount(columns, weights=s[rows], minlength=n_features) + penalty(v[:-1]), s.sum())

        step, residual = np.zeros_like(grad), -grad
        direction, size = residual.copy(), float(residual @ residual)
        target = 1e-4 * size
        for _ in range(40):
            if size <= max(target, 1e-12):
                break
            image = hessian(direction)
            alpha = size / float(direction @ image)
            step += alpha * direction
            residual -= alpha * image
            size, old = float(residual @ residual), size
            direction = residual + (size / old) * direction
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        w, b = w + step[:-1], b + float(step[-1])
        if np.abs(step).max() < 1e-4:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature hashes, weights, intercept) learned from labels(doc_id, toxic).

    Reads at most SAMPLE_ROWS labelled documents of each class, the ones with the
    smallest hash of their id; their weights restore the shares of the classes.
    Features are chosen by the significance of their log-odds in the sample.
    Without both classes nothing can be learned: no features, and the intercept is
    that of the one class there is, or of class 0.
    """
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    labels = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {row.toxic: row.n for row in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return np.zeros(0, np.int64), np.zeros(0), 10.0 if sizes.get(1) else -10.0
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen_ids = [labels.filter(F.col("toxic") == c).orderBy(*by_hash).limit(SAMPLE_ROWS) for c in (0, 1)]
    sample = written(docs.select("doc_id", "text").join(chosen_ids[0].unionByName(chosen_ids[1]), "doc_id"), "sample")
    found = written(features_of(sample), "sampled")
    rows = {row.toxic: row.n for row in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    held = F.explode("features").alias("feature")
    counts = (
        found.select("toxic", held)
        .groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .filter(F.col("a") + F.col("b") >= MIN_TEXTS)
    )

    def log_odds(hits: str, total: int) -> Column:
        return F.log((F.col(hits) + 0.5) / (F.lit(total + 0.5) - F.col(hits)))

    z = (log_odds("a", rows[1]) - log_odds("b", rows[0])) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.select("feature").orderBy(F.desc(F.abs(z)), "feature").limit(FEATURES)
    features = np.array(sorted(row.feature for row in best.collect()), np.int64)

    matrix = (
        found.select("doc_id", "toxic", F.explode_outer("features").alias("feature"))
        .join(best.select("feature", F.lit(1).alias("known")), "feature", "left")
        .groupBy("doc_id", "toxic")
        .agg(F.sort_array(F.collect_list(F.when(F.col("known") == 1, F.col("feature")))).alias("features"))
        .orderBy("doc_id", "features")
        .toArrow()  # a bounded sample; no Python object per feature on the driver
        .combine_chunks()
    )
    toxic = matrix.column("toxic").to_numpy().astype(float)
    lists = matrix.column("features").combine_chunks()
    index = np.repeat(np.arange(len(toxic)), lists.value_lengths().to_numpy())
    columns = np.searchsorted(features, lists.flatten().to_numpy())
    del matrix, lists
    weight = np.where(toxic == 1, sizes[1] / max(1, toxic.sum()), sizes[0] / max(1, (1 - toxic).sum()))
    weight *= len(toxic) / weight.sum()
    swaps = [(r.plus, r.minus, r.times) for r in counterfactuals(sample, features).orderBy("plus", "minus").collect()]
    w, b = fit_weights(index, columns, toxic, weight, swaps, len(features), fairness)
    return features, w, b


def scores(docs: DataFrame, features: np.ndarray, weights: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, starts, words = split_words(part.column("text"))
                table = word_features(words)
                place = np.searchsorted(features, table) if len(features) else np.zeros_like(table)
                known = features[np.minimum(place, len(features) - 1)] == table if len(features) else table < 0
                hit = known.any(axis=1)
                text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                held = hit[codes]
                text, codes = text[held], codes[held]
                pairs = text[:, None] * max(1, len(features)) + place[codes]
                pairs = np.unique(pairs[known[codes]])
                total = np.bincount(
                    pairs // max(1, len(features)),
                    weights=weights[pairs % max(1, len(features))] if len(pairs) else None,
                    minlength=part.num_rows,
                )
                score = 1 / (1 + np.exp(-np.clip(total + intercept, -700, 700)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def remainder(doc_id: Column | str) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string")) % 5


def toxicity(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text).

    Labels of documents whose crc32(doc_id as text) is divisible by 5 are held out
    and never read by the fit. A text is the set of its words (letters and digits, lower
    case) and their first letters, hashed to 63 bits; whole texts count.

    Null and empty texts get the score of a text without features; a null doc_id is
    not held out; repeated rows are scored alike. Rows of labels with a null are
    ignored, and the larger of contradicting labels counts. Other columns are
    ignored; empty docs give no rows.
    """
    bounded_batches(docs.sparkSession)
    features, weights, intercept = fit(docs, labels.filter(remainder("doc_id") != 0), fairness)
    return scores(docs, features, weights, intercept).select(
        "doc_id",
        F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
