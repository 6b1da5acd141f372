"""Name cleaning, matching and finding, against brute force and known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bellwether.functions.similarity import _by_rows, common_subsequence_length
from bellwether.functions.text import clean_company_name, strip_inc
from bellwether.operators import entities, matching
from bellwether.operators.matching import containing_pairs, overlapping_pairs, similar_pairs

COMPANIES = [
    ("Alphabet Inc. (Class A)", "GOOGL"),
    ("Alphabet Inc. (Class C)", "GOOG"),
    ("Apple Inc.", "AAPL"),
    ("Microsoft", "MSFT"),
    ("Amazon", "AMZN"),
    ("Nvidia", "NVDA"),
    ("Meta Platforms", "META"),
    ("Tesla Inc.", "TSLA"),
    ("Adobe Inc.", "ADBE"),
    ("Netflix", "NFLX"),
    ("Advanced Micro\u00a0Devices Inc.", "AMD"),
    ("ADP", "ADP"),
]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b))


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame(COMPANIES, "company string, ticker string")


@pytest.fixture(scope="module")
def aliases(spark, dim):
    return entities.resolve_aliases(entities.common_names(spark), dim)


def test_clean_company_name(spark):
    names = {
        "Advanced Micro\u00a0Devices Inc.": "advanced micro devices",
        "Group 1 Technologies, LLC": "1",
        "Incorp & Co-op plc": "incorp op",
        "  ": "",
        "Soci\u00e9t\u00e9 G\u00e9n\u00e9rale": "soci\u00e9t\u00e9 g\u00e9n\u00e9rale",
    }
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    got = {r.n: r.c for r in df.select("n", clean_company_name(F.col("n")).alias("c")).collect()}
    assert got.pop(None) == ""
    assert got == names
    row = spark.createDataFrame([("Apple Inc. ",)], "n string").select(strip_inc(F.col("n"))).first()
    assert row[0] == "Apple"


def test_common_subsequence_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [
        tuple("".join(rng.choice("abc d\u00e9") for _ in range(rng.randint(1, 80))) for _ in "ab")
        for _ in range(120)
    ]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select(
        "a",
        "b",
        common_subsequence_length(F.col("a"), F.col("b")).alias("n"),
        _by_rows(F.col("a"), F.col("b")).alias("m"),
    ).collect():
        assert r.n == r.m == lcs(r.a, r.b)


def noisy(rng, name, edits):
    letters = list(name)
    for _ in range(edits):
        at = rng.randrange(len(letters) + 1)
        if rng.random() < 0.5 and len(letters) > 2 and at < len(letters):
            del letters[at]
        else:
            letters.insert(at, rng.choice("abcde "))
    return "".join(letters)


@pytest.mark.parametrize("bound", [70.0, 80.5, 94.5])
def test_similar_pairs_loses_no_pair(spark, bound):
    rng = random.Random(int(bound))
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 24))) for _ in range(40)]
    right = sorted(set(base))
    left = sorted({noisy(rng, n, rng.randint(0, 6)) for n in base for _ in range(4)} | {"a"})
    wanted = {(a, b) for a in left for b in right if ratio(a, b) > bound}
    got = similar_pairs(
        spark.createDataFrame([(x,) for x in left], "l string"),
        spark.createDataFrame([(x,) for x in right], "r string"),
        bound,
        "l",
        "r",
    ).collect()
    assert {(r.l, r.r) for r in got} == wanted and len(got) == len(wanted)
    for r in got:
        assert r.ratio == pytest.approx(ratio(r.l, r.r))


def test_similar_pairs_refuses_low_bounds(spark):
    one = spark.createDataFrame([("a",)], "n string")
    with pytest.raises(ValueError):
        similar_pairs(one, one, 50.0, "n", "n")


def test_containing_pairs_against_brute_force(spark):
    words = ["ab", "cd", "efg", "h"]
    names = [" ".join(p) for k in (1, 2, 3) for p in itertools.product(words, repeat=k)]
    left, right = names[::2], names[1::3]
    wanted = {
        (a, b)
        for a in left
        for b in right
        if set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split())
    }
    got = containing_pairs(
        spark.createDataFrame([(x,) for x in left], "l string"),
        spark.createDataFrame([(x,) for x in right], "r string"),
        "l",
        "r",
    ).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)


def test_fuzzy_match_against_brute_force(spark, rows):
    rng = random.Random(8)
    official = ["Green River Bank", "Green River Banks", "Blue Ocean", "blue ocean", "Iron Works"]
    names = [noisy(rng, n, k) for n in official for k in (0, 1, 2, 3, 5, 8)] + ["BLUE OCEAN", None]

    def best(name):
        same = [o for o in official if o.lower() == name.lower()]
        if same:
            return (min(same), "exact")
        scored = [(-round(ratio(name.lower(), o.lower())), o) for o in official if name]
        close = [x for x in scored if -x[0] > 80]
        return (min(close)[1], "fuzzy") if close else None

    wanted = sorted({(n, *best(n)) for n in names if n and best(n)}, key=str)
    got = entities.fuzzy_match(
        spark.createDataFrame([(n,) for n in names], "company string"),
        spark.createDataFrame([(o,) for o in official], "official string"),
    )
    assert rows(got) == wanted
    assert {k for _, _, k in wanted} == {"exact", "fuzzy"}


RESOLVED = {
    "Google": "GOOGL",
    "google": "GOOGL",
    "Alphabet Inc. (Class A)": "GOOGL",
    "GOOGL": "GOOGL",
    "goog": "GOOG",
    "Apple": "AAPL",
    "AAPL": "AAPL",
    "Apple Inc.": "AAPL",
    "Microsoft Corp": "MSFT",
    "Microsoft 365": "MSFT",
    "Amazon.com Inc.": "",
    "NVIDIA Corporation": "NVDA",
    "Tesla": "TSLA",
    "NonExistentCompany": "",
    "XYZTICKER": "",
    "Adobe": "ADBE",
    "Netflix inc": "NFLX",
    "Meta Platforms": "META",
    "Platforms Meta": "META",
    "Advanced Micro Device": "AMD",
    "google stco ktowmorrow": "",
    " ": "",
}


def test_resolve_names(spark, dim, aliases):
    names = spark.createDataFrame([(n,) for n in RESOLVED] * 2 + [(None,)], "name string")
    got = entities.resolve_names(names, dim, aliases).collect()
    assert {r.name: r.company for r in got} == RESOLVED and len(got) == len(RESOLVED)
    as_named = {
        r.name: r.company
        for r in entities.resolve_names(names, dim, aliases, as_ticker=False).collect()
    }
    # Tickers and aliases give tickers, the last step the listed name.
    assert as_named["Microsoft Corp"] == "MSFT" and as_named["Microsoft 365"] == "Microsoft"


def test_resolve_aliases_steps(spark, dim, rows):
    guesses = spark.createDataFrame(
        [
            ("same", "Microsoft"),
            ("clean", "Tesla, Inc."),
            ("close", "Advanced Micro Devicez"),
            ("inside", "Netflix Pictures"),
            ("none", "Unlisted Thing"),
        ],
        "common string, official string",
    )
    assert rows(entities.resolve_aliases(guesses, dim)) == [
        ("clean", "Tesla Inc."),
        ("close", "Advanced Micro\u00a0Devices Inc."),
        ("inside", "Netflix"),
        ("same", "Microsoft"),
    ]


def test_normalize_companies_drops_unresolved_rows(spark, dim, aliases, rows):
    mentions = spark.createDataFrame(
        [("Apple", 1), ("Apple", 2), ("nobody", 3), (None, 4)], "company string, id int"
    )
    assert rows(entities.normalize_companies(mentions, dim, aliases)) == [("AAPL", 1), ("AAPL", 2)]


def test_lookups(spark, dim, rows):
    names = spark.createDataFrame([("Apple Inc.",), ("AAPL",), ("ADP",), ("no",)], "name string")
    assert rows(entities.tickers_of(names, dim)) == [
        ("AAPL", "AAPL"),
        ("ADP", "ADP"),
        ("Apple Inc.", "AAPL"),
        ("no", None),
    ]
    tickers = spark.createDataFrame([("aapl",), ("xyz",)], "ticker string")
    assert rows(entities.companies_of(tickers, dim)) == [("aapl", "Apple Inc."), ("xyz", None)]


def test_gazetteer_takes_longest_name_first(spark, rows):
    known = spark.createDataFrame(
        [("Meta",), ("Meta Platforms",), ("Alphabet",), ("Alphabet Inc.",), ("C1",), ("C12",), ("A+B",)],
        "company string",
    )
    questions = spark.createDataFrame(
        [
            (1, "what about META platforms"),
            (2, "meta platforms and Meta"),
            (3, "is alphabet inc. good"),
            (4, "C12, not metadata"),
            (5, "nothing here"),
            (6, "why a+b?"),
        ],
        "question_id int, question string",
    )
    assert rows(entities.gazetteer_match(questions, known)) == [
        (1, "Meta Platforms"),
        (2, "Meta Platforms"),
        (2, "Meta"),
        (3, "Alphabet"),
        (4, "C12"),
        (6, "A+B"),
    ]


def test_question_terms_and_fallback(spark, dim, aliases, rows):
    questions = spark.createDataFrame(
        [
            (1, "What about Google and, tsla tomorrow"),
            (2, "Show me the market"),
            (3, "Compare MSFT or apple"),
        ],
        "question_id int, question string",
    )
    assert rows(entities.question_terms(questions)) == [
        (1, "Google"),
        (1, "tsla"),
        (3, "Compare"),
        (3, "MSFT"),
        (3, "apple"),
    ]
    known = spark.createDataFrame([("MSFT",)], "company string")
    asked = entities.companies_in_questions(questions, known, dim, aliases)
    assert rows(asked) == [(1, "GOOGL"), (1, "TSLA"), (3, "MSFT")]


def test_extract_company_takes_the_earliest_name(spark, dim, aliases, rows):
    names = entities.name_list(dim, aliases)
    headlines = spark.createDataFrame(
        [
            (1, "Tesla beats Google"),
            (2, "Shares of AMD and Apple Inc. rise"),
            (3, "adp in lower case is no ticker, nvidia is a name"),
            (4, "nothing"),
            (5, None),
            (6, "Meta Platforms leads"),
        ],
        "id int, headline string",
    )
    wanted = [(1, "TSLA"), (2, "AMD"), (3, "ADP"), (6, "META")]
    copies = headlines.union(headlines).withColumn("company", F.lit("old"))
    assert rows(entities.extract_company(headlines, names, "id")) == wanted
    attached = entities.attach_companies(copies, names)
    assert sorted(attached.columns) == ["company", "headline", "id"]
    found = attached.filter("company is not null").select("id", "company")
    assert rows(found) == sorted(wanted * 2)
    assert attached.count() == 12


def test_repeated_alias_resolves_once(spark, dim, rows):
    aliases = spark.createDataFrame(
        [("big fruit", "Apple Inc."), ("big fruit", "Tesla, Inc.")], "common string, company string"
    )
    names = spark.createDataFrame([("Big Fruit",)], "name string")
    assert entities.resolve_names(names, dim, aliases).count() == 1


def word_set(a, b):
    """The best of the three word-set ratios, straight from their definition."""
    x, y = set(a.split()), set(b.split())
    s, l, r = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    both = [(s + " " + l, s + " " + r), (s, s + " " + l), (s, s + " " + r)]
    first = 100 - 100 * (len(l) + len(r) - 2 * lcs(l, r)) / (len(both[0][0]) + len(both[0][1]))
    return max(first, *(200 * len(p) / (len(p) + len(q)) for p, q in both[1:]))


def partial(a, b):
    x, y = set(a.split()), set(b.split())
    near = 2 * max(len(a), len(b)) < 3 * min(len(a), len(b))
    return near and bool(x & y) and bool(x - y) and bool(y - x)


@pytest.mark.parametrize("bound", [89.5, 89.5 / 0.95])
def test_overlapping_pairs_loses_no_pair(spark, bound):
    rng = random.Random(int(10 * bound))
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(25)]
    left = {" ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(40)}
    right = set()
    for name in left:
        for _ in range(3):
            parts = [noisy(rng, w, rng.choice((0, 0, 1))).replace(" ", "") or "a" for w in name.split()]
            rng.shuffle(parts)
            right.add(" ".join(parts + rng.sample(["x", "yz"], rng.randint(0, 1))))
    right = sorted(right | set(list(left)[:20]) | {"aaa aaa bbb", "aaa bbbb"})
    left = sorted(left | {"aaa aaa ccc", "aaa bbb"})
    wanted = {(a, b): word_set(a, b) for a in left for b in right if partial(a, b) and word_set(a, b) > bound}
    got = overlapping_pairs(
        spark.createDataFrame([(x,) for x in left], "l string"),
        spark.createDataFrame([(x,) for x in right], "r string"),
        "l", "r", bound,
    ).collect()
    assert {(r.l, r.r) for r in got} == set(wanted) and len(got) == len(wanted) > 3
    for r in got:
        assert r.score == pytest.approx(wanted[r.l, r.r])


def test_overlapping_pairs_with_a_word_in_common(spark):
    """A word that all names share makes no pairs: what is scored stays near what is found."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(400)]
    left = spark.createDataFrame([(f"international {w}",) for w in base], "l string")
    right = spark.createDataFrame([(f"{w}s international",) for w in base], "r string")
    found = overlapping_pairs(left, right, "l", "r", 89.5 / 0.95)
    scored = []
    original = matching.word_set_score
    try:
        matching.word_set_score = lambda a, b: scored.append(1) or F.lit(100.0)
        candidates = matching.overlapping_pairs(left, right, "l", "r", 89.5 / 0.95).count()
    finally:
        matching.word_set_score = original
    assert scored and found.count() >= 400 and candidates < 4 * found.count()


def test_substring_pairs_against_brute_force(spark):
    rng = random.Random(11)
    inner = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 6))) for _ in range(80)})
    outer = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 30))) for _ in range(120)})
    got = matching.substring_pairs(
        spark.createDataFrame([(x,) for x in inner], "i string"),
        spark.createDataFrame([(x,) for x in outer] + [("",)], "o string"),
        "i", "o",
    ).collect()
    wanted = {(i, o) for i in inner for o in outer if i in o and i != o}
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)


def test_partial_word_sets_resolve_aliases(spark):
    dim = spark.createDataFrame([("General Widget Manufacturing Works", "GWMW"), ("Other", "O")], "company string, ticker string")
    guesses = spark.createDataFrame(
        [("widgets", "Works Manufacturing Widgets General"), ("none", "Widget Sellers Association")], "common string, official string"
    )
    assert [tuple(r) for r in entities.resolve_aliases(guesses, dim).collect()] == [
        ("widgets", "General Widget Manufacturing Works")
    ]
