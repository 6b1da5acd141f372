"""Scans, sinks, merging, context selection and the daily run."""

import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwether.functions.values import epoch_to_timestamp
from bellwether.operators import context, entities, mentions, sentiment, stats
from bellwether.plans import daily
from bellwether.schemas import GROWTH, PREDICTIONS, require_columns
from bellwether.sources import landed, prices, readers, sinks


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_lenient_scan_skips_long_rows_and_repairs_names(spark, tmp_path, rows):
    path = write(
        tmp_path / "a.csv",
        'Company,Sentiment,Sentiment_Score,Date\nA,positive,0.5,2024-01-01T00:00:00Z\n'
        'B,x,1,2,3,4\nC,negative\n"D, Inc.",neutral,bad,"2024-01-02\n00:00:00"\n',
    )
    df = readers.read_lenient(
        spark, path, ["company", "sentiment_score", "timestamp"], multi_line=True
    )
    assert df.columns == ["company", "sentiment", "sentiment_score", "timestamp"]
    assert rows(df, "company", "sentiment_score") == [("A", "0.5"), ("C", None), ("D, Inc.", "bad")]
    scored = readers.mention_scores(df)
    assert rows(scored, "company", "sentiment_score") == [("A", 0.5), ("C", 0.0), ("D, Inc.", 0.0)]


def test_lenient_scan_tries_other_dialects(spark, tmp_path, rows):
    path = write(tmp_path / "b.csv", "company;symbol\nSoci\u00e9t\u00e9;SG\n")
    df = readers.read_lenient(spark, path, ["company", "symbol"])
    assert rows(df) == [("Soci\u00e9t\u00e9", "SG")]
    quoted = write(tmp_path / "c.csv", '"company,symbol\nA,"B\n')
    with pytest.raises(ValueError):
        readers.read_lenient(spark, quoted, ["company", "none"])


def test_scores_from_labels(spark, rows):
    df = spark.createDataFrame(
        [("A", "Very_Negative", None), ("B", None, None)],
        "company string, sentiment string, timestamp timestamp",
    )
    assert rows(readers.mention_scores(df), "company", "sentiment_score") == [("A", -1.0), ("B", 0.0)]
    with pytest.raises(ValueError, match="timestamp"):
        readers.mention_scores(df.drop("timestamp"))


def test_fallbacks(spark, tmp_path, rows):
    missing = str(tmp_path / "missing.parquet")
    df = readers.read_or_else(
        lambda: readers.read_parquet(spark, missing), lambda: readers.fallback_companies(spark)
    )
    assert df.count() == 6
    with pytest.raises(AnalysisException):
        readers.read_or_else(lambda: readers.read_parquet(spark, missing))
    empty = readers.read_or_empty(
        spark, lambda: readers.read_parquet(spark, missing), PREDICTIONS
    )
    assert empty.schema == PREDICTIONS and empty.isEmpty()
    named = readers.company_and_symbol(
        spark.createDataFrame([("A", "B", 1)], "`Long Name` string, t string, x int")
    )
    assert named.columns == ["company", "symbol"]
    with pytest.raises(ValueError):
        readers.company_and_symbol(named.select("company"))
    assert readers.first_present(named, readers.COMPANY_COLUMNS) == "company"


def test_required_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="a, b"):
        require_columns(df, ["a", "id", "b"])


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("A", "up")], PREDICTIONS)
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    sinks.write_to_all(df, paths)
    sinks.write_to_all(df, paths[:1])
    assert [rows(spark.read.parquet(p)) for p in paths] == [[("A", "up")]] * 2
    sinks.write_table(df, str(tmp_path / "csv"), csv=True)
    assert rows(readers.read_csv(spark, str(tmp_path / "csv"), PREDICTIONS)) == [("A", "up")]


def test_price_files_and_pushdown(spark, tmp_path, rows):
    folder = tmp_path / "bars"
    folder.mkdir()
    head = "Date,Close,High,Low,Open,Volume\n"
    write(folder / "aapl.csv", head + "2024-01-02,2,3,1,1.5,10\n2024-01-03,3,4,2,2.5,20\n")
    write(folder / "MSFT.csv", head + "2024-01-02,5,6,4,5,30\n")
    bars = prices.read_price_files(spark, str(folder), "2024-01-02", "2024-01-03")
    assert rows(bars, "ticker", "open", "close", "volume") == [
        ("AAPL", 1.5, 2.0, 10),
        ("MSFT", 5.0, 5.0, 30),
    ]
    table = str(tmp_path / "table")
    prices.write_price_table(bars, table)
    back = prices.read_price_table(spark, table, "2024-01-01").filter("ticker = 'MSFT'")
    assert back.count() == 1
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan
    assert "GreaterThanOrEqual(trade_date" in plan


def test_news_payloads(spark, tmp_path, rows):
    payload = {
        "keyword": "AAPL",
        "articles": [
            {"publishedAt": "2024-01-01T10:00:00Z", "title": "t", "description": "d", "url": "u",
             "source": {"id": None, "name": "n"}},
            {"title": "only title"},
        ],
    }
    path = write(tmp_path / "news.json", json.dumps(payload) + '\n{"keyword": "X", "articles": []}\n')
    news = landed.read_news(spark, path)
    assert rows(landed.typed_news(landed.news_rows(news))) == [
        (None, "news", "only title", None, None, "AAPL"),
        (datetime(2024, 1, 1, 10), "news", "t", "d", "u", "AAPL"),
    ]
    assert landed.trending_rows(news).count() == 2
    listing = write(tmp_path / "list.json", json.dumps([{"title": "", "date": "d1"}, {"source": "s"}]))
    assert rows(landed.news_listing(landed.read_news_listing(spark, listing))) == [
        ("No Title", "N/A", "d1", "N/A", "", "#"),
        ("No Title", "s", "N/A", "N/A", "", "#"),
    ]


def test_theme_keywords_and_scores(spark, rows):
    doc = spark.createDataFrame([('{"rates": ["Fed", "rate"], "jobs": ["rate"], "none": ["zzz"]}',)], "d string")
    pairs = landed.theme_keywords(doc, "d")
    assert rows(pairs) == [("fed", "rates"), ("rate", "jobs"), ("rate", "rates"), ("zzz", "none")]
    from bellwether.operators.themes import theme_sentiment

    said = spark.createDataFrame(
        [("Fed rate rate", "positive"), ("rate fed!", "negative"), ("FED", "odd"), (None, "positive")],
        "headline string, sentiment string",
    )
    got = theme_sentiment(said, pairs).select(
        "theme", "positive", "neutral", "negative", "macro_sentiment_score"
    )
    assert rows(got) == [("jobs", 2, 0, 1, 0.333), ("rates", 3, 0, 1, 0.5)]


def test_cap_per_source(spark, rows):
    df = spark.createDataFrame([("s", i) for i in range(9)] + [("t", 1)], "subreddit string, n int")
    capped = landed.cap_per_source(df, [F.desc("n")], limit=3)
    assert rows(capped) == [("s", 6), ("s", 7), ("s", 8), ("t", 1)]


def news_and_posts(spark):
    news = spark.createDataFrame(
        [
            ("2024-01-02T00:00:00Z", "h1", "t1", "u1", "A"),
            ("not a date", "h2", "t2", "u2", None),
            ("2024-01-01T00:00:00Z", "h3", "", "u3", "B"),
            ("2024-01-01T00:00:00Z", None, "t4", "u4", "B"),
        ],
        "publishedAt string, title string, description string, url string, company string",
    )
    posts = spark.createDataFrame(
        [("h5", "t5", 1704067200.5, "u5", "")],
        "title string, text string, created_utc double, url string, company string",
    )
    return news, posts


def test_merge_sources(spark):
    got = mentions.merge_sources(*news_and_posts(spark))
    assert got.columns == mentions.MENTION_COLUMNS
    assert [(r.headline, r.source, r.company) for r in got.collect()] == [
        ("h1", "news", "A"),
        ("h5", "reddit", None),
        ("h2", "news", None),
    ]
    assert got.collect()[1].timestamp == datetime(2024, 1, 1, 0, 0, 0, 500000)


def test_attach_sentiment_matches_missing_times_and_multiplies(spark):
    news, posts = news_and_posts(spark)
    scored = spark.createDataFrame(
        [
            (None, "h2", "t2", "X", "positive", 1.0),
            (None, "h2", "t2", "Y", "negative", -1.0),
            (datetime(2024, 1, 3), "h1", "t1", "Z", "neutral", 0.0),
        ],
        "timestamp timestamp, headline string, text string, company string, sentiment string, "
        "sentiment_score double",
    )
    merged = mentions.merge_with_sentiment(news.drop("company"), posts.drop("url"), scored)
    got = [(r.headline, r.url, r.company) for r in merged.collect()]
    assert got[:2] == [("h1", "u1", None), ("h5", None, None)]
    assert sorted(got[2:]) == [("h2", "u2", "X"), ("h2", "u2", "Y")]


def test_headline_lists_ignore_case_and_keep_three(spark):
    df = spark.createDataFrame(
        [("a", "h1", 1, None), ("A", "h2", 2, datetime(2024, 1, 1)), ("A", "h3", 3, datetime(2024, 1, 2)),
         ("A", "h4", 4, datetime(2024, 1, 2)), (None, "h5", 5, None), ("B", None, 6, None)],
        "company string, headline string, id int, timestamp timestamp",
    )
    got = {r.company_key: r.headlines for r in mentions.headline_lists(df, [F.col("id")]).collect()}
    assert got == {"A": ["h3", "h4", "h2"], "B": [None]}


def growth_table(spark, n=30):
    table = [(f"C{i}", 0.0, 0.0, "up", float(n - i), 0.0, 1) for i in range(n)]
    return spark.createDataFrame(table, GROWTH)


def test_select_context(spark):
    questions = spark.createDataFrame([(i,) for i in range(4)], "question_id int")
    asked = spark.createDataFrame(
        [(1, "c29"), (1, "C3"), (1, "none"), (2, "none")]
        + [(3, f"C{i}") for i in range(28)],
        "question_id int, company string",
    )
    got = context.select_context(questions, asked, growth_table(spark)).collect()
    by = {q: [r.company for r in sorted(got, key=lambda r: r.position) if r.question_id == q] for q in range(4)}
    assert by[0] == [f"C{i}" for i in range(25)]
    assert by[1] == ["C3", "C29"] + [f"C{i}" for i in range(24) if i != 3]
    assert by[2] == []
    assert by[3] == [f"C{i}" for i in range(28)]
    assert [r.queried for r in got if r.question_id == 1 and r.position <= 3] == [True, True, False]


def test_context_lines(spark):
    df = spark.createDataFrame(
        [("A", "up", 0.125, None, 0.5, 3, ["x", "y"]), ("B", None, 0.0, 1.0, None, None, None)],
        "company string, ml_prediction string, time_decayed_sentiment double, growth_score double, "
        "sentiment_score double, total_mentions bigint, headlines array<string>",
    )
    lines = [r[0] for r in df.select(context.context_line()).collect()]
    assert lines[0] == (
        "- A:\n  - ML Prediction for Tomorrow: up\n  - Time-Decayed Sentiment: 0.13\n"
        "  - Overall Growth Score: N/A\n  - Base Sentiment Score: 0.50\n"
        "  - Total News Mentions: 3\n  - Top Headlines: x; y"
    )
    assert lines[1].endswith("  - Total News Mentions: N/A\n")


def test_joins_ignoring_case_and_optional_theme(spark, rows):
    left = spark.createDataFrame([("a", 1), ("B", 2)], "company string, n int")
    right = spark.createDataFrame([("A", 5, 7)], "company string, n int, m int")
    joined = context.join_ignoring_case(left, right)
    assert joined.columns == ["company", "n", "n_right", "m"]
    assert rows(joined) == [("B", 2, None, None), ("a", 1, 5, 7)]
    themes = spark.createDataFrame([("x", 0.5)], "theme string, macro_sentiment_score double")
    assert rows(context.join_theme(left, themes)) == [("B", 2, None), ("a", 1, None)]
    assert rows(context.join_theme(left, None)) == [("B", 2, None), ("a", 1, None)]
    themed = left.withColumn("theme", F.when(F.col("n") == 1, "x"))
    assert rows(context.join_theme(themed, themes), "company", "macro_sentiment_score") == [
        ("B", None),
        ("a", 0.5),
    ]


def test_daily_run(spark, tmp_path, rows):
    article = {"publishedAt": "2024-01-02T00:00:00Z", "description": "growth ahead", "url": "u"}
    payload = {
        "keyword": "k",
        "articles": [
            {**article, "title": "Apple sees profit"},
            {**article, "title": "Google faces loss", "description": "loss again"},
            {**article, "title": "Nobody sees profit"},
        ],
    }
    post = {"title": "apple profit", "text": "nice", "created_utc": 1704067200.0, "url": "p", "subreddit": "s"}
    news = write(tmp_path / "n.json", json.dumps(payload) + "\n")
    posts = write(tmp_path / "p.json", json.dumps(post) + "\n")
    dim = spark.createDataFrame(
        [("Apple Inc.", "AAPL", "Tech", "x"), ("Alphabet Inc. (Class A)", "GOOGL", "Tech", "y")],
        "company string, ticker string, sector string, sub_industry string",
    )
    paths = daily.run_daily(
        spark,
        news,
        posts,
        dim,
        entities.common_names(spark),
        spark.createDataFrame([("AAPL", "up")], PREDICTIONS),
        spark.createDataFrame([("profit", "money")], "keyword string, theme string"),
        sentiment.lexicon_scorer({"profit": 1.4, "loss": -1.5, "growth": 1.5}),
        str(tmp_path / "out"),
    )
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    assert tables["scored_mentions"].count() == 4
    assert rows(tables["company_mentions"]) == [("AAPL", 2), ("GOOGL", 1)]
    assert rows(tables["macro_sentiment"], "theme", "positive") == [("money", 3)]
    growth = {r.company: r for r in tables["predict_growth"].collect()}
    assert growth["AAPL"].growth_score == pytest.approx(1.0)
    assert growth["GOOGL"].growth_score == pytest.approx(-0.75)
    counts = dict((r.keyword, r["count"]) for r in tables["cms_keywords"].collect())
    assert counts["profit"] == 3


def test_bad_epochs_are_missing(spark):
    rows = spark.createDataFrame([("abc",), ("NaN",), ("1e300",), (None,), ("86400",)], "s string")
    got = [r.t for r in rows.select(epoch_to_timestamp(F.col("s")).alias("t")).collect()]
    assert got[:4] == [None] * 4 and got[4] is not None


def test_only_a_missing_path_is_empty(spark, tmp_path):
    schema = "company string"
    gone = readers.read_or_empty(
        spark, lambda: spark.read.parquet(str(tmp_path / "none")), T.StructType.fromDDL(schema)
    )
    assert gone.collect() == []
    with pytest.raises(AnalysisException):
        readers.read_or_empty(
            spark, lambda: spark.range(1).select("nope"), T.StructType.fromDDL(schema)
        )


def test_case_clashes_join_once(spark, rows):
    left = spark.createDataFrame([("acme", 1)], "company string, a int")
    right = spark.createDataFrame([("ACME", 2), ("Acme", 3)], "company string, b int")
    assert rows(context.join_ignoring_case(left, right)) == [("acme", 1, 2)]


def test_summary_skips_nan_and_keeps_infinity(spark):
    values = [1.0, 2.0, float("nan"), 3.0, None]
    row = stats.summary(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (row["count"], row["mean"], row["min"], row["q50"], row["max"]) == (3, 2.0, 1.0, 2.0, 3.0)
    values += [float("inf")]
    row = stats.summary(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (row["count"], row["min"], row["max"]) == (4, 1.0, float("inf"))
