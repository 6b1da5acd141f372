"""Personal data: patterns against plain regular expressions, the segment model against enumeration."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwether.llm.personal_data import examples_from, masked, personal_data, span_report, spans_of
from bellwether.llm.queries import QUERIES
from bellwether.llm.span_model import Model, _Lattice, atoms_of, candidates, fitted, made_examples, regions
from bellwether.llm.span_patterns import KINDS, base_spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The contract's patterns as they stand."""
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(x) for x in re.findall("[0-9]", m[0])]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            keep = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if keep:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def cases():
    rng = random.Random(4)
    out = ["", " ", "@", "a@b", "a@b.c@d.e", "x.@-.-", "%+a@b.c%d@e.f.", "a@@b.c", "a@b..c", "1.2.3.4.5.6.7.8", "001.02.3.255"]
    out += ["1.2.3.256", "0000.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (743) 555-3824", "+1(", "++12345678 9", "+1 23456789."]
    out += ["٣٣٣@x.y", "é+4 12345678-é", "4111  1111 1111 1111", "+1 (578) 555-6437 4918187128635271"]
    parts = ["@", ".", "-", " ", "+", "(", ")", "a", "B2", "25", "255", "4111", "1111", "%", "_", "é", "\n"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    return out + [t for t, _ in made_examples(["the", "of"], 400, 1)]


def test_patterns():
    for text in cases():
        assert base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("unit", ["a", "1", "a@", "1.", "+1(", "1 ", "a.b@", "12 34 at ", "[at] "])
def test_long_texts_take_time_in_proportion(unit):
    model = Model({}, np.zeros((0, 4)), 0.0)
    text = unit * (200_000 // len(unit)) + " x"
    began = time.process_time()
    spans_of(text, model)
    assert time.process_time() - began < 60


@pytest.fixture(scope="module")
def model():
    return fitted(examples_from(["the quick brown fox jumps over the lazy dog and runs away from here"] * 3))


def every_segmentation(n, edges):
    """All sets of segments without overlap."""
    for size in range(4):
        for chosen in itertools.combinations(edges, size):
            ordered = sorted(chosen)
            if all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:], strict=False)):
                yield ordered


TEXTS = ["+1 (743) 555-3824", "a@b.c 8.8.8.8", "1234567 7654321", "x [at] y dot z", "10.0.0.1,10.0.0.2"]


@pytest.mark.parametrize("text", TEXTS)
def test_best_segmentation(model, text):
    rng = np.random.default_rng(len(text))
    any_model = Model(model.places, rng.normal(0, 1, model.weights.shape), -0.7)
    atoms = atoms_of(text)[:9]
    edges = [(i, j, any_model.score(f)) for i, j, f in candidates(atoms)]
    best = 0.0
    for chosen in every_segmentation(len(atoms), [(i, j, s.max()) for i, j, s in edges]):
        touching = sum(a[1] == b[0] for a, b in zip(chosen, chosen[1:], strict=False))
        best = max(best, sum(s for _, _, s in chosen) + any_model.touching * touching)
    got = any_model.segments(atoms)
    scores = {(i, j): s for i, j, s in edges}
    total = sum(scores[i, j][KINDS.index(k)] for i, j, k in got)
    total += any_model.touching * sum(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert total == pytest.approx(best)


def test_likelihood_and_gradient():
    examples = [("+1 743 5553824", [("phone", 0, 14)]), ("7 1.2.3.4.5", [("ip", 2, 9)]), ("at a@b.c", []), ("none", [])]
    lattice = _Lattice(examples)
    rng = np.random.default_rng(2)
    weights, touching = rng.normal(0, 0.3, (len(lattice.places), 4)), 0.4
    slope, own, value = lattice.gradient(weights, touching)
    # The log of the sum over all segmentations, by enumeration of segments and kinds.
    scores, total = lattice.scores(weights), 0.0
    for row, _ in enumerate(lattice.lengths):
        own_edges = np.flatnonzero(lattice.row == row)
        listed = [(int(lattice.first[e]), int(lattice.end[e]), k, e) for e in own_edges for k in range(4)]
        sums = []
        for chosen in every_segmentation(lattice.lengths[row], listed):
            touch = sum(a[1] == b[0] for a, b in zip(chosen, chosen[1:], strict=False))
            sums.append(sum(scores[e, k] for _, _, k, e in chosen) + touching * touch)
        total += np.log(np.exp(sums).sum())
    held = lattice.gold >= 0
    assert value == pytest.approx(scores[held, lattice.gold[held]].sum() - total, abs=1e-3)
    for f, k in [(0, 0), (3, 3), (10, 1), (len(lattice.places) - 1, 2)]:
        moved = weights.copy()
        moved[f, k] += 1e-5
        assert (lattice.gradient(moved, touching)[2] - value) / 1e-5 == pytest.approx(slope[f, k], abs=1e-3)
    assert (lattice.gradient(weights, touching + 1e-5)[2] - value) / 1e-5 == pytest.approx(own, abs=1e-3)


def test_held_out_examples(model):
    told = right = wanted = 0
    for text, spans in made_examples(["nine", "green", "tables", "stood", "there", "quietly"], 1500, 77):
        _, got = spans_of(text, model)
        told, wanted, right = told + len(got), wanted + len(spans), right + len(set(got) & set(spans))
    assert right / told > 0.95 and right / wanted > 0.95


def test_regions_cover_all_base_spans():
    for text in cases():
        found = regions(text)
        for _, a, b in base_spans(text):
            if b - a > 7:
                assert any(x <= a and b <= y for x, y in found) or b - a > 90, text


def rows():
    out = [(i, t) for i, t in enumerate(cases()[:300])]
    out += [(None, "call +1 743 555-3824"), (None, None), (5, None), (5, "x@y.zz"), (5, "x@y.zz"), (6, "é" * 50 + "a@b.cc " * 5000)]
    return out + [(7, "😀 mail bob.smith [at] mail [dot] example [dot] com now, or (743) 555-3824")]


def test_report(spark, model):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, base string, spans int")
    found = personal_data(docs.repartition(3), model)
    wanted = []
    for i, t in rows():
        base, spans = plain_spans(t or ""), spans_of(t or "", model)[1]
        assert set(base) <= set(spans)
        shown = [",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (base, spans)]
        counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        wanted.append((i, *counts, hashlib.sha256(shown[0].encode()).hexdigest(), shown[1]))
    got = [tuple(r) for r in span_report(found).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert any(r[0] == 7 and r[-1] == "email:7:50,phone:59:73" for r in got), [r for r in got if r[0] == 7]


def test_masked(spark, model):
    docs = spark.createDataFrame([(7, rows()[-1][1]), (8, "no data"), (9, "")], "doc_id long, text string")
    found = personal_data(docs, model).select("doc_id", "spans").join(docs, "doc_id").orderBy("doc_id")
    got = [r[0] for r in found.select(masked("text", F.col("spans"))).collect()]
    assert got == ["😀 mail <email> now, or <phone>", "no data", ""]


def test_empty(spark):
    assert span_report(personal_data(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op12_personal_data"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        base = plain_spans(docs[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in KINDS)
        assert set(shown.split(",")) <= set(r.spans.split(","))
