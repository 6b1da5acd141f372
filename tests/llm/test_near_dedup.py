"""Near duplicates and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwether.llm import buckets, near_dedup
from bellwether.llm.components import components
from bellwether.llm.near_dedup import BINS, near_duplicates, sketch
from bellwether.llm.words import mixed

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    out, word = [], ""
    for c in lower(text):
        if c in " \t\n\v\f\r":
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    """{doc_id: (n, component)} of distinct, non-null ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and both:
                a, b = sorted((root(x), root(y)))
                least[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, text, times):
    w = text.split(" ")
    for _ in range(times):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(60, 160))) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "One", "one two", "ONE two", "one two three", "A\x0bB\x0cC\rD", *base]
    texts += [b.upper().replace("W", "w") for b in base[:3]] + [base[0]] * 4
    # A large group around one text, from nearly equal to too far away.
    for i in range(90):
        texts.append(edited(rng, base[1], i % 14))
    for b in base[2:]:
        for times in (1, 2, 4, 8):
            texts.append(edited(rng, b, times))
    # A chain: each link is near enough, its ends are not.
    chain = base[5]
    for _ in range(8):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * place, texts[i]) for place, i in enumerate(order)]


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 85, 256), (3, 85, 4), (5, 80, 4)])
def test_against_all_pairs(spark, monkeypatch, k, percent, small):
    monkeypatch.setattr(buckets, "SMALL", small)
    monkeypatch.setattr(buckets, "PIVOTS", small)
    monkeypatch.setattr(near_dedup, "RARE", small // 2)
    rows = corpus(k)
    want = brute(rows, k, percent)
    docs = spark.createDataFrame([(i, t, "c", "k") for i, t in rows], SCHEMA).repartition(5)
    got = near_duplicates(docs, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_screen_leaves_small_buckets(spark, monkeypatch):
    """Near pairs of which one member lies in a large bucket of a template, the other in small ones only."""
    monkeypatch.setattr(buckets, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "RARE", 4)
    template = range(20)
    sets, keys = {}, {0: []}
    for g in range(12):
        first, x, y = 3 * g, 3 * g + 1, 3 * g + 2
        own = range(100 * g + 100, 100 * g + 110)
        sets[first] = [*template, *range(100 * g + 150, 100 * g + 160)]
        sets[x], sets[y] = [*template, *own, -g - 1], [*template, *own]
        # The smallest of the small bucket is near to neither.
        keys[g + 1], keys[0] = [first, x, y], [*keys[0], y]
    want = set()
    for ids in keys.values():
        for a in ids:
            for b in ids:
                both = len({*sets[a]} & {*sets[b]})
                if a < b and 100 * both >= 80 * len({*sets[a]} | {*sets[b]}):
                    want.add((b, a))
    assert len(want) == 12
    items = spark.createDataFrame(list(sets.items()), "id long, items array<long>").cache()
    rows = [(key, i, len(sets[i]), 0) for key, ids in keys.items() for i in ids]
    most = F.least(F.col("n") - F.col("own"), F.col("n_2") - F.col("own_2"))
    label = buckets.bucket_components(
        spark.createDataFrame(rows, "key long, id long, n long, own long"),
        100 * most >= 80 * (F.col("n") + F.col("n_2") - most),
        lambda pairs: near_dedup._linked(pairs, items, 80),
        lambda ids: near_dedup._rare(ids, items, 80),
    )
    assert {(r.id, r.component) for r in label.collect()} == want


def test_marks_never_tell_too_much():
    rng = np.random.default_rng(4)
    for size in (1, 40, 300, 5000):
        items = mixed(rng.integers(0, 2**62, 2 * size).astype(np.uint64))
        a, b = items[: size + size // 2], items[size // 2 :]
        one, other = near_dedup.marks(a), near_dedup.marks(b)
        assert len(one) == near_dedup.MARKS
        assert np.bitwise_count(one & ~other).sum() <= len(np.setdiff1d(a, b))


def test_far_members_of_a_family_are_not_fetched(spark, monkeypatch):
    """Variants of one text that share buckets but are not near: few pairs may meet with their sets."""
    rng = random.Random(6)
    base = " ".join(rng.choices([f"w{i}" for i in range(400)], k=120))
    rows = [(i, edited(rng, base, 2 if i % 6 == 0 else rng.randrange(7, 10))) for i in range(150)]
    fetched, linked = [], near_dedup._linked

    def counted(pairs, *others):
        fetched.append(pairs.count())
        return linked(pairs, *others)

    monkeypatch.setattr(near_dedup, "_linked", counted)
    docs = spark.createDataFrame([(i, t, "c", "k") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 3, 85).collect()}
    want = brute(rows, 3, 85)
    assert got == want
    assert sum(fetched) < 600, fetched


def test_one_id_with_several_texts(spark):
    """Ids with several texts have no marks of their own, and keep all their links."""
    rng = random.Random(7)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(80)) for _ in range(2)]
    near = [edited(rng, t, 1) for t in texts]
    rows = [(1, near[0]), (1, near[1]), (5, texts[0]), (6, texts[1])]
    docs = spark.createDataFrame([(i, t, "c", "k") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, 3, 85).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (6, 1)]


def test_nulls_repeats_and_empty(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (5, text), (5, text), (4, text), (9, None), (8, "")]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, 3, 85).collect()), key=str
    )
    assert got == sorted(
        [(None, 6, None, True), (5, 6, 4, False), (5, 6, 4, False), (4, 6, 4, True), (9, 0, 9, True), (8, 0, 8, True)],
        key=str,
    )
    assert near_duplicates(docs.limit(0), 3, 85).collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(1000 + rng.randrange(30), 1000) for _ in range(60)] + [(7, 7), (None, 3)]
    links += [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]
    least = {}

    def root(i):
        while least.setdefault(i, i) != i:
            i = least[i]
        return i

    for a, b in links:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            least[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in least if root(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sketch_agrees_like_jaccard():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        items = mixed(rng.integers(0, 2**62, 150).astype(np.uint64))
        agree.append((sketch(items[:100]) == sketch(items[20:120])).mean())
    assert abs(np.mean(agree) - 80 / 120) < 0.03
    for n in (1, 2, 5):
        items = mixed(np.arange(n, dtype=np.uint64) + np.uint64(9))
        assert len(sketch(items)) == BINS and (sketch(items) == sketch(items[::-1].copy())).all()
