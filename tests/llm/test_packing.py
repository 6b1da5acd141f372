"""Best fit under conflicts against a plain search."""

import random

from bellwether.llm.packing import best_fit, packed, packed_documents


def plain(sizes, sources, clusters, capacity):
    bins, places = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (b["left"], i)
            for i, b in enumerate(bins)
            if b["left"] >= size and b["left"] > 0
            and (source is None or source not in b["sources"])
            and (cluster is None or cluster not in b["clusters"])
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        bins[i]["left"] -= size
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
        places.append(i)
    return places


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(80)
        sizes = [rng.randrange(0, 101) for _ in range(n)]
        sources = [rng.choice([None, "a", "a", "b", "c", "d", "e"]) for _ in range(n)]
        clusters = [rng.choice([None, None, 1, 2, 3]) for _ in range(n)]
        assert best_fit(sizes, sources, clusters, 100) == plain(sizes, sources, clusters, 100)


def test_packed(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr("bellwether.llm.packing.SHARD_PIECES", 150)
    rows = [(i, rng.choice([0, 5, 30, 99, 100, 250]), rng.choice(["hot", "hot", "x", "y", None]), rng.choice([None, 7, 8])) for i in range(400)]
    rows += [(1000, 10, "z", 1)] * 90 + [(None, 3, None, None)] * 2
    docs = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, size long, source string, cluster long, bin string")
    got = packed(docs.repartition(3), 100).collect()
    words, members = {}, {}
    cluster = {r[0]: r[3] for r in rows}
    for r in got:
        at = (r.shard, r.bin)
        words[at] = words.get(at, 0) + r.n_words
        members.setdefault(at, []).append(r)
    assert max(words.values()) <= 100
    for found in members.values():
        sources = [r.source for r in found if r.source is not None]
        own = [cluster[r.doc_id] for r in found if cluster[r.doc_id] is not None]
        ids = [r.doc_id for r in found if r.doc_id is not None]
        assert len(sources) == len(set(sources)) and len(own) == len(set(own)) and len(ids) == len(set(ids))
        assert sorted(r.place for r in found) == list(range(len(found)))
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, []).append((r.first_word, r.n_words))
    for doc_id, size, _, _ in rows[:400]:
        parts = sorted(covered[doc_id])
        assert sum(n for _, n in parts) == size
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert len(covered[1000]) == 90 and len(covered[None]) == 2
    again = packed(docs.repartition(2), 100).filter("doc_id <> 1000").collect()
    first = [tuple(r) for r in got if r.doc_id is not None and r.doc_id != 1000]
    assert len(again) == len(first)


def test_documents(spark):
    text = "Some Words here"
    rows = [(1, text, "a"), (2, text.upper() + "  ", "b"), (3, None, "c"), (4, "", None), (5, "w " * 5000, "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = packed_documents(docs).collect()
    place = {}
    for r in got:
        place.setdefault(r.doc_id, []).append((r.shard, r.bin, r.n_words))
    assert place[1][0][:2] != place[2][0][:2]
    assert [p[2] for p in place[3]] == [0] and [p[2] for p in place[4]] == [0]
    assert sorted(p[2] for p in place[5]) == [904, 2048, 2048]
    assert packed_documents(docs.limit(0)).collect() == []
