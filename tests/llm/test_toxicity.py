"""The classifier on planted insults, and what swapped identity terms change."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bellwether.llm import toxicity as toxicity_module
from bellwether.llm.toxicity import fit, remainder, scores, swapped_sentences, toxicity, word_features

INSULTS = ["blorgish", "snarfel", "gruntak"]


def corpus(n=700):
    rng = random.Random(3)
    vocabulary = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randrange(5, 120))
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(["", "!", "s"]))
        # One group is mentioned in toxic texts far more often than its neighbour.
        if rng.random() < (0.9 if toxic else 0.1):
            w.insert(rng.randrange(len(w)), "muslims")
        elif rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "christians")
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_swaps(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, toxic string, score double")
    marked = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs.repartition(3), marked).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(held) and len(got) == len(rows)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())

    learn = marked.filter(remainder("doc_id") != 0)
    pair = spark.createDataFrame([(0, "plain1 plain2 muslims meet"), (1, "plain1 plain2 christians meet")], "doc_id long, text string")
    gap = {}
    for fairness in (0.0, 10.0):
        low, high = sorted(r.score for r in scores(pair, *fit(docs, learn, fairness)).collect())
        gap[fairness] = np.log(high / (1 - high)) - np.log(low / (1 - low))
    assert gap[10.0] < 0.2 * gap[0.0]


def test_edges(spark):
    rows, labels = corpus(200)
    odd = [(900, None), (901, ""), (902, "..."), (None, "blorgish"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(docs, marked).collect()
    assert len(got) == len(rows) + 5
    empty = {r.score for r in got if r.doc_id in (900, 901, 902)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    none = marked.limit(0)
    assert {r.predicted for r in toxicity(docs, none).collect()} == {0}
    assert toxicity(docs.limit(0), marked).collect() == []
    only = marked.withColumn("toxic", F.lit(1))
    assert {r.predicted for r in toxicity(docs, only).collect()} == {1}


def test_swaps_and_features():
    pairs = list(swapped_sentences("A Women walk. Two men\nno term"))
    assert pairs == [("A Women walk", "A men walk"), (" Two men", "Two women")]
    table = word_features(pa.array(["Word!", "wo", "--", "WORDs"]))
    assert table.shape == (4, 3) and (table[2] == 0).all() and table[1, 0] != 0 and (table[1, 1:] == 0).all()
    assert table[0, 1] == table[3, 1] and table[0, 0] != table[3, 0]


def plain_features(text):
    """The feature hashes of a text, word by word."""
    found = set()
    for word in set((text or "").replace("\x0b", " ").replace("\x0c", " ").split()):
        found |= set(word_features(pa.array([word], pa.large_string())).ravel().tolist())
    return found - {0}


def test_scores_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    words = "vile rotten kind day the of Clown! idiot, sunny people".split()
    known = np.array(sorted(plain_features(" ".join(words[:7]))), np.int64)
    weights = rng.normal(size=len(known))
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(80)]
    rows += [(None, "vile day"), (5, None), (5, ""), (7, "vile " * 30_000 + "kind")]
    got = toxicity_module.scores(spark.createDataFrame(rows, "doc_id long, text string"), known, weights, -0.5).collect()
    place = {f: i for i, f in enumerate(known.tolist())}
    want = []
    for i, text in rows:
        total = sum(weights[place[f]] for f in plain_features(text) if f in place) - 0.5
        want.append((i, round(1 / (1 + np.exp(-total)), 9)))
    assert sorted(((r.doc_id, round(r.score, 9)) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("fairness", [0.0, 2.0])
def test_fit_is_the_minimum_of_the_whole_loss(fairness):
    """The dense gradient of the penalised loss, written out, is zero where the fit ends."""
    rng = np.random.default_rng(4)
    x = (rng.random((300, 12)) < 0.3).astype(float)
    toxic = (x[:, 0] + x[:, 1] + rng.normal(0, 0.5, 300) > 0.7).astype(float)
    weight = rng.random(300) + 0.5
    swaps = [([0], [2], 5), ([3, 4], [], 2), ([], [1], 1)]
    index, columns = np.nonzero(x)
    w, b = toxicity_module.fit_weights(index, columns, toxic, weight, swaps, 12, fairness)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    slope = x.T @ (weight * (p - toxic)) + toxicity_module.RIDGE * w
    all_times = sum(t for _, _, t in swaps)
    for plus, minus, times in swaps:
        change = np.zeros(12)
        change[plus], change[minus] = 1, -1
        slope += fairness * 300 * times / all_times * (change @ w) * change
    assert np.abs(slope).max() < 0.05 and abs((weight * (p - toxic)).sum()) < 0.05
    if fairness:
        free, _ = toxicity_module.fit_weights(index, columns, toxic, weight, swaps, 12, 0.0)
        assert abs(w[0] - w[2]) < 0.5 * abs(free[0] - free[2])
