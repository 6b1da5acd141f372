"""Source targets, rates and copies against plain arithmetic."""

import math
import random

from bellwether.llm.mixing import mixed_sources, taken_documents

SCHEMA = "doc_id long, text string, source string, size string, target string, mix_size string"


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 400)), rng.choice(["b", "a", "é", "z", None])) for i in range(300)]
    rows += [(i, "same words here", "big") for i in range(300, 600)]
    rows += [(600 + i, " ".join(["x"] * rng.randrange(200)), "big") for i in range(200)]
    rows += [(900, None, "empty"), (901, "", "empty"), (902, " \n", "empty"), (903, "only one", "few"), (None, "no id", "a")]
    rows += [(905, "x " * 3000, "long"), (906, "y", "long")]
    return rows + rows[:2]


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = float(sum(sizes.values()))
    target, full = {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > cap * sizes[s] * (1 + 1e-12)} - full
        if not over:
            return target
        full |= over


def test_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA).repartition(4)
    got = mixed_sources(docs).collect()
    count = {(i, t, s): len((t or "").split()) for i, t, s in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count[(i, t, s)]
    want = plain_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken, rate, most = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        most[s] = max(most.get(s, 0), r.size)
        rate.setdefault((s, r.size), []).append(r.copies)
    assert len(got) == len(rows)
    for s, words in taken.items():
        assert abs(words - want[s]) <= max(2, 0.02 * want[s]) or s in ("few", "long"), (s, words, want[s])
        assert abs(words - want[s]) <= max(1, most[s])
    # Equal documents take numbers of copies that differ by one at most.
    assert all(max(c) - min(c) <= 1 for (s, size), c in rate.items() if s != "long" and len(c) > 20)
    again = mixed_sources(docs.repartition(2)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)

    repeated = taken_documents(docs)
    assert repeated.columns == docs.columns
    times = {}
    for r in repeated.collect():
        times[(r.doc_id, r.text, r.source)] = times.get((r.doc_id, r.text, r.source), 0) + 1
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
    for (i, t, s), n in times.items():
        assert n == total[i]
    assert sum(times.values()) == sum(r.copies for r in got)


def test_tilt_is_exponential_in_the_size(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice((10, 40, 160)), "a") for i in range(6000)]
    rows += [(10_000 + i, "w " * 50, "b") for i in range(100)] + [(20_000, "w", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_size = {}
    for r in mixed_sources(docs).filter("doc_id < 10000").collect():
        by_size.setdefault(r.size, []).append(r.copies)
    rate = {n: sum(c) / len(c) for n, c in by_size.items()}
    # log(rate) / size is the same for all sizes of a source below the cap.
    tilt = [math.log(rate[n]) / n for n in (40, 160)]
    assert rate[10] > 0 and abs(tilt[0] - tilt[1]) < 0.02 * max(map(abs, tilt)) + 1e-4


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixed_sources(docs).collect() == [] and taken_documents(docs).collect() == []


def test_repeated_and_null_ids_come_near_the_target(spark):
    text = "ten words of one text that many rows all repeat"
    rows = [(7, text, "a")] * 1000 + [(None, text, "b")] * 900 + [(100 + i, text + str(i), "c") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixed_sources(docs).collect()
    for name, ids in (("a", lambda i: i == 7), ("b", lambda i: i is None)):
        own = [r for r in got if ids(r.doc_id)]
        taken, target = sum(r.taken for r in own), own[0].target
        assert abs(taken - target) < 0.06 * target, (name, taken, target)
        assert 0 < taken != 2 * own[0].source_size and max(r.copies for r in own) - min(r.copies for r in own) <= 1
