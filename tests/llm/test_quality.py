"""Quality rules on edge cases (the whole table is held against SQL)."""

import random

import numpy as np

from bellwether.llm.quality import quality, repeated_words, with_common_lines_removed

SCHEMA = "doc_id long, text string, source string, kept string, row long, lines string"


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(covered)


def test_repeated_words():
    rng = random.Random(1)
    for _ in range(200):
        codes = [rng.randrange(4) for _ in range(rng.randrange(25))]
        assert repeated_words(np.array(codes, np.int64)) == plain_repeats(codes)


def test_edges(spark):
    rng = random.Random(2)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    common = " ".join(f"common{i}" for i in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", "a"), (4, "a#b *$ é|", None), (5, "x\nx\n\n y\nx", "a")]
    # Twenty documents of one host share a line; it is most of the first ten only.
    rows += [(10 + i, f"{common.upper()}\n{prose(30 if i < 10 else 90)}", "h") for i in range(20)]
    # Copies of one document are one document.
    copy = prose(70)
    rows += [(40 + i, copy, "h") for i in range(30)]
    rows += [(80, common + "\n" + prose(30), "other"), (None, prose(60), "h"), (5, "again", "a")]
    docs = spark.createDataFrame([(*r, "k", 1, "l") for r in rows], SCHEMA).repartition(4)
    got = {}
    for r in quality(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i in (1, 2, 3):
        assert tuple(got[i][0])[1:] == (0, 0, 0, 0, 0, 0, True, False)
    assert tuple(got[4][0])[1:5] == (3, 7, 4, 0)
    assert {(r.n_words, r.n_dup_lines) for r in got[5]} == {(4, 2), (1, 0)}
    for i in range(20):
        r = got[10 + i][0]
        assert r.n_common_words == 60 and not r.base_failed and r.kept == (i >= 10)
    assert all(got[40 + i][0].kept and got[40 + i][0].n_common_words == 0 for i in range(30))
    assert got[80][0].n_common_words == 0 and got[80][0].kept and got[None][0].kept
    assert quality(docs.limit(0)).collect() == []


def test_common_lines_are_cut(spark):
    """Kept documents lose the lines of the host's boilerplate, in any case, number and place."""
    rng = random.Random(4)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    rows, want = [], []
    for i in range(12):
        body = [prose(40), "", prose(40)]
        cut = [f"Page {100 + i} of 12", *body, "", "  all RIGHTS  reserved", f"page {200 + i} OF 12"]
        rows.append((i, "\n".join(cut), "h", -1))
        kept = "\n".join([*body, ""])
        want.append((i, kept, "h", len(kept)))
    rows += [(20, "Page 101 of 12\n" + prose(60), "other", -1), (None, prose(60), None, -1), (21, "all rights reserved", "h", -1)]
    depleted = " ".join(f"common{j}" for j in range(60))
    rows += [(30 + i, f"{depleted}\n{prose(20)}", "g", -1) for i in range(9)]
    rows += [rows[0], (40, None, "h", -1)]
    want += [rows[12], rows[13], want[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(4)
    got = with_common_lines_removed(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert with_common_lines_removed(docs.limit(0)).collect() == []
