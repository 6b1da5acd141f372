"""Fused language evidence against the same sums in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

from bellwether.llm import language
from bellwether.llm.language import BUCKETS, OWN_WEIGHT, TEXT_GRAMS, identify, page_evidence

SYLLABLES = {"aa": ["ka", "ki", "ko", "ta"], "bb": ["mel", "sur", "ven", "lor"], "cc": ["üx", "öz", "iq", "ew"]}
SCHEMA = "doc_id long, text string, lang string, source string, host string, kept string"


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        declared = lang if rng.random() < 0.85 else rng.choice(["aa", "bb", "cc", None, ""])
        rows.append((i, prose(rng, lang, rng.randrange(1, 60)), declared, f"s{i % 3}" if rng.random() < 0.9 else None))
    junk = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300))
    rows += [(500, None, "aa", "s0"), (501, "", "bb", "s1"), (502, "12 34 5", "aa", "s0"), (503, junk, None, "s0")]
    return rows + [(None, prose(rng, "bb", 30), "bb", "s1"), rows[0]]


def pages(rows):
    out = []
    for i, _, lang, _ in rows[:150]:
        if i is not None and i % 2:
            out.append((f"https://www.h{i % 4}.example.{'net' if i % 3 else 'org'}/x/{i}?a=1", f'<HTML class="p" lang="{lang or ""}"><body>'))
    out += [("http://nothing.example.com/about", "<html>"), (None, None), ("http://z.example.net/1", '<html lang=bb>')]
    return out


def triples(text):
    return language._triples(pa.array([text]))[0]


def brute(rows, found):
    """{row: (language, posterior)} from the same counts, summed one by one."""
    clean = [(i, t or "", (d or "").strip().lower() or None, s) for i, t, d, s in rows]
    names = sorted({d for i, _, d, _ in clean if d and i is not None})
    table = np.full((len(names) + 1, BUCKETS), 0.5)
    for i, t, d, _ in clean:
        if d and i is not None:
            np.add.at(table[names.index(d)], triples(t), 1)
    table[-1] = 1
    table = np.log(table / table.sum(axis=1, keepdims=True))
    names.append("und")
    items = []
    for i, t, d, s in clean:
        b = triples(t)
        ll = table[:, b].sum(axis=1) * min(1, TEXT_GRAMS / max(1, len(b)))
        markup, host = found.get(i, (None, None))
        used = host or s
        parent = used and (used.split(".", 1)[1] if used.count(".") > 1 else used)
        suffix = host and host.rsplit(".", 1)[-1]
        items.append((ll.round(6), {"declared": d, "markup": markup, "suffix": suffix, "host": used, "parent": parent}))
    best = [int(np.argmax(ll)) for ll, _ in items]
    size = len(names)

    def counts(key, value):
        return np.bincount([b for b, (_, e) in zip(best, items) if e[key] == value], minlength=size).astype(float)

    everyone = np.bincount(best, minlength=size)
    base = (everyone + 1) / (everyone.sum() + size)

    def smooth(own, up):
        return (own + OWN_WEIGHT * up) / (own.sum() + OWN_WEIGHT)

    out = []
    for ll, e in items:
        prior = base
        if e["host"]:
            up = e["parent"]
            known = counts("parent", up if up.count(".") < 2 else None)
            of_parent = smooth(counts("parent", up), base) if up in {x["parent"] for _, x in items} else base
            prior = smooth(counts("host", e["host"]), of_parent)
            del known
        score = np.log(prior) + ll
        for key in ("declared", "markup", "suffix"):
            if e[key]:
                values = len({x[key] for _, x in items if x[key]}) + 1
                score = score + np.log((counts(key, e[key]) + 1) / (everyone + values))
        p = np.exp(score - score.max())
        out.append((names[int(np.argmax(p))], 1 / p.sum()))
    return out


def test_against_plain_sums(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], SCHEMA).repartition(3)
    evidence = page_evidence(spark.createDataFrame(pages(rows), "url string, html string"))
    found = {r.doc_id: (r.markup, r.host) for r in evidence.collect()}
    assert found[1] == ("bb", "z.example.net") and found[3][1] == "www.h3.example.org"
    want = {}
    for row, result in zip(rows, brute(rows, found)):
        want.setdefault(row[0], result)
    got = identify(docs, evidence).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.language == want[r.doc_id][0], r
        assert math.isclose(r.posterior, want[r.doc_id][1], rel_tol=1e-6)
    verdict = {r.doc_id: r.kept for r in got}
    assert not any(verdict[i] for i in (500, 501, 502, 503))
    truth = {i: ("aa", "bb", "cc")[i % 3] for i in range(240)}
    assert np.mean([r.language == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.97
    assert np.mean([verdict[i] for i in truth]) > 0.95
    assert identify(docs.limit(0), evidence).collect() == []


def test_rare_and_many_languages(spark, monkeypatch):
    """Each of 70 languages has its share of the sample, and the unknown one keeps its texts."""
    monkeypatch.setattr(language, "SAMPLE_ROWS", 40)
    rng = random.Random(8)

    def own(k, n):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(8)]
        return " ".join("".join(rng.choices(letters, k=4)) for _ in range(n))

    rows = [(i, prose(rng, "aa", 40), "aa", None) for i in range(600)]
    rows += [(1000 + k, own(k, 60), f"l{k:02}", None) for k in range(69)]
    rows += [(2000, own(200, 60), None, None), (2001, "7", "zz", None), (2002, "", "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert len(got) == len(rows)
    for i, _, lang, _ in rows[:-3]:
        assert got[i].language == lang and got[i].kept, got[i]
    assert got[2000].language == "und"
    assert not any(got[i].kept for i in (2000, 2001, 2002))


def test_nothing_declared(spark):
    docs = spark.createDataFrame([(1, "some text", None, None)], "doc_id long, text string, lang string, source string")
    got = identify(docs).collect()
    assert [(r.language, r.kept) for r in got] == [("und", False)]
