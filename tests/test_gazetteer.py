"""Known names in texts by a trie, against the join on words and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bellwether.operators import entities, gazetteer

NAMES = ["Meta", "Meta Platforms", "Alphabet", "Alphabet Inc.", "C1", "C12", "A+B", "(x) y", "y", "x", "Étoile", "big, co", "big", "co"]


def plain(text, names):
    """Longest name first, each removed from the text before the next; of names in the text as it is asked."""
    low = text.lower()
    stands = [n for n in names if re.search(r"\b" + re.escape(n.lower()) + r"\b", low)]
    rest, found = low, []
    for name in sorted(stands, key=lambda n: (-len(n), n)):
        if re.search(r"\b" + re.escape(name.lower()) + r"\b", rest):
            found.append(name)
            rest = rest.replace(name.lower(), "")
    return found


def texts():
    rng = random.Random(2)
    parts = ["meta", "META platforms", "alphabet inc.", "alphabet", "c1", "C12", "c123", "a+b", "(x) y", "x", "y", "étoile", "big, co", "big", "co"]
    rows = [None, "", "  ", "metadata", "C1"]
    rows += ["".join(rng.choice(parts) + rng.choice((" ", " ", ", ", "-", "")) for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    return rows + ["big co " * 20_000]


@pytest.mark.parametrize("held", [100, 3])
def test_equal_to_plain_search(spark, monkeypatch, held, rows):
    monkeypatch.setattr(gazetteer, "HELD", held)
    listed = list(enumerate(texts()))
    if held == 3:
        listed = listed[:-1]
    asked = spark.createDataFrame(listed, "question_id int, question string")
    known = spark.createDataFrame([(n,) for n in [*NAMES, "", None, "Meta"]], "company string")
    got = rows(gazetteer.names_in_texts(asked, known))
    assert got == sorted(((i, n) for i, t in listed if t for n in plain(t, NAMES)), key=str)


def test_names_that_lie_in_one_another():
    trie = gazetteer.Trie(["a b c", "b c", "c", "a b d", "b"])
    assert sorted(n for _, _, n in trie.hits("a b c")) == [0, 1, 2, 4]
    assert gazetteer.longest_first("a b c b", [("a b c", "a b c"), ("b c", "b c"), ("c", "c"), ("b", "b")]) == ["a b c", "b"]


def test_first_name_is_resolved(spark, rows):
    dim = spark.createDataFrame(
        [("Apple Inc.", "AAPL"), ("Meta Platforms", "META"), ("Tesla, Inc.", "TSLA")], "company string, ticker string"
    )
    aliases = spark.createDataFrame([("fruit", "Apple Inc."), ("meta", "Gone")], "common string, company string")
    heads = [(1, "Fruit and Tesla, Inc"), (2, "aapl is no ticker, AAPL is"), (3, "Meta Platforms up"), (4, "none"), (5, None), (6, "")]
    headlines = spark.createDataFrame(heads, "id int, headline string")
    got = rows(gazetteer.resolved_companies(headlines, dim, aliases, "id"))
    assert got == [(1, "fruit", "AAPL"), (2, "AAPL", "AAPL"), (3, "Meta Platforms", "META")]
    by_join = entities.extract_company(headlines, entities.name_list(dim, aliases), "id")
    assert rows(by_join) == [(i, c) for i, _, c in got]
    names = entities.name_list(dim, aliases).withColumn("n", F.lit(1))
    assert gazetteer.earliest_names(headlines.limit(0), names, "id").collect() == []


def test_long_lists_find_the_same_first_name(spark, monkeypatch, rows):
    names = [(n, False) for n in NAMES] + [("META", True), ("C1", True), ("Up", True), ("up", False)]
    listed = spark.createDataFrame(names, "spelling string, as_written boolean")
    heads = [(i // 2 if i % 7 else None, t) for i, t in enumerate([*texts()[:-1], "Up or up", "up, Up", "META, meta"])]
    headlines = spark.createDataFrame(heads, "id int, headline string")
    by_trie = rows(gazetteer.earliest_names(headlines, listed, "id"))
    monkeypatch.setattr(gazetteer, "HELD", 3)
    assert rows(gazetteer.earliest_names(headlines, listed, "id")) == by_trie
    assert len(by_trie) > 100 and any(i is None for i, _ in by_trie)
