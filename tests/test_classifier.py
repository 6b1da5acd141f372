"""The sentiment classifier against a plain fit, and on held-out texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwether.operators import classifier, fitting, sentiment
from bellwether.operators.classifier import BUCKETS, PASSES, SHRINK
from bellwether.operators.sentiment import LABELS
from bellwether.plans.queries import QUERIES

WORDS = {
    "negative": "loss fall crash fear weak",
    "neutral": "flat steady calm same level",
    "positive": "gain rise record strong boom",
}


def texts(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice(LABELS)
        words = [rng.choice(WORDS[label].split()) for _ in range(rng.randrange(1, 4))]
        words += [rng.choice("the of and company shares today in".split()) for _ in range(rng.randrange(0, 9))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), label))
    return spark.createDataFrame(rows, "doc_id long, text string, sentiment string")


def plain_fit(rows):
    """The same steps on one dense matrix."""
    x = np.zeros((len(rows), BUCKETS + 1))
    for i, (cells, _) in enumerate(rows):
        for c in cells:
            x[i, c] = 1 / math.sqrt(len(cells))
    x[:, -1] = 1
    y = np.zeros((len(rows), 3))
    y[np.arange(len(rows)), [LABELS.index(label) for _, label in rows]] = 1
    used = np.flatnonzero(x.any(axis=0))
    w = np.zeros((BUCKETS + 1, 3))
    first = second = np.zeros_like(w)
    for step in range(1, PASSES + 1):
        p = np.exp(x[:, used] @ w[used])
        p /= p.sum(axis=1, keepdims=True)
        slope = np.zeros_like(w)
        slope[used] = x[:, used].T @ (y - p) / len(rows)
        slope -= SHRINK * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w + fitting.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w


def test_fit_equals_plain_fit(spark):
    rows = texts(spark, 120, 1).repartition(5)
    got = classifier.fit(rows)
    listed = rows.select(classifier.buckets(F.col("text")).alias("c"), "sentiment").collect()
    assert np.allclose(got, plain_fit([(r.c, r.sentiment) for r in listed]), atol=1e-6)


def test_held_out_texts(spark):
    train, test = texts(spark, 400, 2), texts(spark, 200, 3)
    weights = classifier.fit(train)
    row = classifier.accuracy(classifier.classified(test, weights, "doc_id"), test, "doc_id").first()
    assert row.documents == 200 and row.accuracy > 0.95


def test_scores_are_softmax(spark):
    weights = classifier.fit(texts(spark, 60, 4))
    rows = [(1, "gain and loss"), (2, ""), (3, None), (4, " !! "), (5, "unseen words only"), (6, "gain " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cells = {r.doc_id: r.c for r in docs.select("doc_id", classifier.buckets(F.col("text")).alias("c")).collect()}
    for r in classifier.classified(docs, weights, "doc_id").collect():
        if not cells[r.doc_id]:
            assert (r.sentiment, r.confidence) == ("neutral", 0.0)
            continue
        s = weights[cells[r.doc_id]].sum(axis=0) / math.sqrt(len(cells[r.doc_id])) + weights[-1]
        p = np.exp(s) / np.exp(s).sum()
        assert r.sentiment == LABELS[int(np.argmax(p))] and r.confidence == pytest.approx(p.max())


def test_no_labelled_text(spark):
    none = spark.createDataFrame([(1, "x", "unknown"), (2, None, "positive")], "doc_id long, text string, sentiment string")
    assert classifier.fit(none) is None
    assert [r.confidence for r in classifier.classified(none, None, "doc_id").orderBy("doc_id").collect()] == [
        pytest.approx(1 / 3), 0.0
    ]


def test_tree_of_sums(spark):
    rows = spark.range(0, 1000, 1, 100).repartition(100)

    def part(batches):
        values = [x for b in batches for x in b.column("id").to_pylist()]
        return np.array([sum(values), len(values)], float) if values else None

    assert fitting.summed(rows, part).tolist() == [499_500, 1000]
    assert fitting.summed(rows.filter("id < 0"), part) is None


def test_lexicon_scores_equal_the_column_form(spark):
    table = spark.createDataFrame([("gain", 1.5), ("loss", -2.0), ("the", 0.25)], "keyword string, weight double")
    docs = texts(spark, 50, 5).unionByName(
        spark.createDataFrame([(900, None, ""), (901, "", ""), (902, "GAIN gain", "")], "doc_id long, text string, sentiment string")
    )
    got = {r.doc_id: r.lexicon_score for r in sentiment.lexicon_scores(docs, table, "doc_id").collect()}
    column = sentiment.lexicon_score(F.col("text"), {"gain": 1.5, "loss": -2.0, "the": 0.25})
    assert got == {r.doc_id: r.s for r in docs.select("doc_id", column.alias("s")).collect()}


def test_better_than_the_lexicon(spark):
    rows = {r.method: r for r in QUERIES["classifier_accuracy"](spark, "/root/testdata/sf0.1").collect()}
    assert rows["classifier"].documents == rows["lexicon"].documents > 500
    assert rows["classifier"].accuracy > rows["lexicon"].accuracy + 0.02
