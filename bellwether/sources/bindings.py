"""The library's tables, derived from the shared test tables.

Every binding reads whole tables; no row is left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.functions.decay import SECONDS_RATE, decay, reference_time
from bellwether.functions.text import word_tokens
from bellwether.schemas import PREDICTIONS
from bellwether.sources.prices import daily_bars, in_range
from bellwether.sources.steps import new_path

LEXICON_WORDS = 40
LABELS = ("positive", "neutral", "negative")
THEMES = {
    "rates": ["that", "with", "nicht"],
    "growth": ["this", "from", "with"],
    "labour": ["There", "than", "para"],
    "trade": ["tion", "dans", "les"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _headline(text: Column) -> Column:
    """The first line; the whole text where that is empty."""
    first = F.substring_index(text, "\n", 1)
    return F.when(first != "", first).otherwise(text)


def raw_event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention per event, its kind and payload as headline."""
    value, kind = F.col("value"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("headline"),
        F.concat(F.lit("C"), F.col("user_id")).alias("company"),
        F.when(kind.isin("purchase", "signup"), F.lit("positive"))
        .when(kind == "error", F.lit("negative"))
        .otherwise(F.lit("neutral"))
        .alias("sentiment"),
        (value / 1000).alias("confidence"),
    )


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled mentions without text, empty cells NULL."""
    raw = raw_event_mentions(spark, sf_dir)
    return raw.withColumn("company", F.nullif(F.col("company"), F.lit("")))


def mention_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files of all events' mentions, semicolons between cells and a header in each.

    Errors have a cell too many, as a payload with the separator in it makes them.
    """
    raw = raw_event_mentions(spark, sf_dir)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("company", "sentiment", "confidence", "timestamp")]
    line = F.concat_ws(";", *cells, F.when(F.col("sentiment") == "negative", F.col("headline")))
    path = new_path(spark, "mentions")
    header = "Company;Sentiment;Sentiment_Score;Date"
    # One unquoted column, so lines and header are written as they are.
    raw.select(line.alias(header)).write.options(header=True, quote="", sep="\u0001", escape="").csv(path)
    return path


def company_file(spark: SparkSession, sf_dir: str) -> str:
    """A folder of comma-separated files of suppliers, whose first two columns have names of their own."""
    names = table(spark, sf_dir, "supplier")
    path = new_path(spark, "companies")
    columns = [F.col("s_name").alias("Firm"), F.concat(F.lit("C"), "s_suppkey").alias("Code"), F.col("s_acctbal").alias("Rest")]
    names.select(*columns).write.options(header=True).csv(path)
    return path


def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled mentions with the headline, text and url of a document."""
    docs = table(spark, sf_dir, "documents")
    articles = docs.select(
        "doc_id",
        _headline(F.col("text")).alias("headline"),
        "text",
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"),
        "source",
    )
    doc_count = docs.agg(F.count("*")).scalar()
    events = (
        event_mentions(spark, sf_dir)
        .drop("headline")
        .withColumn("doc_id", F.col("event_id") % doc_count)
    )
    return events.join(articles, "doc_id")


def mentioned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that events mention, whole, with what its mentions add up to.

    times, weight (summed decay) and the label counts are per document, so a text
    is read and tokenised once, however often it is mentioned.
    """
    docs = table(spark, sf_dir, "documents")
    rows = event_mentions(spark, sf_dir)
    weight = decay(F.col("timestamp"), reference_time(rows), SECONDS_RATE)
    counted = rows.groupBy((F.col("event_id") % docs.agg(F.count("*")).scalar()).alias("doc_id")).agg(
        F.count("*").alias("times"),
        F.sum(weight).alias("weight"),
        *[F.count_if(F.col("sentiment") == label).alias(label) for label in LABELS],
    )
    return docs.select("doc_id", F.col("text").alias("headline"), "source").join(counted, "doc_id")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keyword, weight): the log odds of a word in labelled texts of quality 1 against 0.

    The words in most labelled texts, LEXICON_WORDS of them.
    """
    labelled = table(spark, sf_dir, "labels").select("doc_id", "quality").join(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"
    )
    words = F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("keyword")
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return (
        labelled.select("quality", words)
        .filter(F.length("keyword") >= 4)
        .groupBy("keyword")
        .agg(good.alias("good"), bad.alias("bad"))
        .orderBy(F.desc(F.col("good") + F.col("bad")), "keyword")
        .limit(LEXICON_WORDS)
        .select("keyword", F.round(F.log((F.col("good") + 1) / (F.col("bad") + 1)), 6).alias("weight"))
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fetched news articles."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.date_format(
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60),
            "yyyy-MM-dd'T'HH:mm:ss'Z'",
        ).alias("publishedAt"),
        _headline(F.col("text")).alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"),
        F.col("source").alias("company"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as forum posts."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        _headline(F.col("text")).alias("title"),
        "text",
        (F.lit(1704067200.0) + F.col("conv_id") * 60 + F.col("turn")).alias("created_utc"),
        F.concat_ws("/", F.lit("conv:"), "conv_id", "turn").alias("url"),
        F.col("role").alias("subreddit"),
        F.lit("").alias("company"),
        "conv_id",
        "turn",
    )


def labelled_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles: the documents that have labels."""
    docs = news(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    sign = F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality"))
    return docs.select(
        F.try_to_timestamp("publishedAt").alias("timestamp"),
        F.col("title").alias("headline"),
        F.col("description").alias("text"),
        "company",
        F.when(sign > 0, F.lit("positive"))
        .when(sign < 0, F.lit("negative"))
        .otherwise(F.lit("neutral"))
        .alias("sentiment"),
        sign.cast("double").alias("sentiment_score"),
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, sentiment) of the labelled documents: toxic ones negative, good ones positive."""
    label = (
        F.when(F.col("toxic") == 1, F.lit("negative"))
        .when(F.col("quality") == 1, F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )
    marks = table(spark, sf_dir, "labels").select("doc_id", label.alias("sentiment"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(marks, "doc_id")


def company_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    return customers.join(
        nations, customers["c_nationkey"] == nations["n_nationkey"]
    ).select(
        F.col("c_name").alias("company"),
        F.concat(F.lit("C"), F.col("c_custkey")).alias("ticker"),
        F.col("c_mktsegment").alias("sector"),
        F.col("n_name").alias("sub_industry"),
    )


def company_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("company"),
        F.col("c_mktsegment").alias("sector"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per supplier; companies without a supplier have none."""
    balance = F.col("s_acctbal")
    return (
        table(spark, sf_dir, "supplier")
        .select(
            F.concat(F.lit("C"), F.col("s_suppkey")).alias("company"),
            F.when(balance > 6000, F.lit("up"))
            .when(balance > 3000, F.lit("down"))
            .otherwise(F.lit("neutral"))
            .alias("ml_prediction"),
        )
        .select(*PREDICTIONS.fieldNames())
    )


def prices(
    spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Daily bars of the line items of each supplier."""
    trades = in_range(table(spark, sf_dir, "lineitem"), start, end, "l_shipdate")
    return daily_bars(
        trades,
        ticker=F.concat(F.lit("C"), F.col("l_suppkey")),
        time=F.col("l_shipdate"),
        price=F.col("l_extendedprice"),
        quantity=F.col("l_quantity"),
        order=[F.col("l_orderkey"), F.col("l_linenumber")],
    )


def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_orders(spark, sf_dir, F.avg("o_totalprice"))


def volatility_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_orders(spark, sf_dir, F.max("o_totalprice"))


def _daily_orders(spark: SparkSession, sf_dir: str, close) -> DataFrame:
    day = F.date_trunc("day", "o_orderdate").cast("timestamp")
    return (
        table(spark, sf_dir, "orders").groupBy(day.alias("trade_date")).agg(close.alias("close"))
    )


def part_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as listed companies, the smallest key as ticker."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_name").alias("company"))
        .agg(
            F.concat(F.lit("P"), F.min("p_partkey")).alias("ticker"),
            F.min("p_brand").alias("sector"),
            F.min("p_type").alias("sub_industry"),
        )
    )


def part_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spelling of its company per part; the part type tells how it is spelt."""
    name, kind = F.col("p_name"), F.col("p_type")
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    spelt = (
        F.when(kind == "ECONOMY", F.concat(name, F.lit(" Inc.")))
        .when(kind == "SMALL", F.concat(F.upper(name), F.lit(", Holdings")))
        .when(kind == "PROMO", F.concat(second, F.lit(" "), first))
        .when(kind == "LARGE", F.expr("substring(p_name, 1, length(p_name) - 1)"))
        .when(kind == "MEDIUM", F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size")))
        .otherwise(F.concat(F.lit("p"), F.col("p_partkey")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", spelt.alias("name"))


def part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per part, whose names lie in one another: the part, its two words and another part's."""
    name, kind = F.col("p_name"), F.col("p_type")
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    asked = (
        F.when(kind == "ECONOMY", F.concat(F.lit("Is "), F.upper(name), F.lit(" better than any "), second, F.lit("?")))
        .when(kind == "SMALL", F.concat(first, F.lit(", "), name, F.lit(" or "), second, F.lit("?")))
        .when(kind == "LARGE", F.concat(second, F.lit("s and "), first, F.lit("-"), second, F.lit(" tomorrow")))
        .otherwise(F.concat(F.lit("Show "), name, F.lit(" for "), F.lower("p_brand")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", asked.alias("question"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and the single words of them, as listed names that overlap."""
    parts = table(spark, sf_dir, "part")
    words = F.explode(F.split("p_name", " ")).alias("company")
    return parts.select(F.col("p_name").alias("company")).union(parts.select(words)).distinct()


def part_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and size as an everyday name of the smallest-spelt company of theirs."""
    parts = table(spark, sf_dir, "part").join(part_spellings(spark, sf_dir), "p_partkey")
    common = F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")), F.lit(" "), F.col("p_size"))
    return parts.groupBy(common.alias("common")).agg(F.min("name").alias("official"))


def nation_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's name as an everyday name of its first customer."""
    return (
        company_dim(spark, sf_dir)
        .groupBy(F.lower("sub_industry").alias("common"))
        .agg(F.min("company").alias("company"))
    )


def order_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One headline per order, naming its customer by name, ticker or nation."""
    orders = table(spark, sf_dir, "orders")
    companies = company_dim(spark, sf_dir)
    named = orders.withColumn("ticker", F.concat(F.lit("C"), F.col("o_custkey"))).join(
        companies, "ticker"
    )
    status = F.col("o_orderstatus")
    return named.select(
        "o_orderkey",
        F.when(
            status == "F",
            F.concat(F.lit("Big order for "), F.col("ticker"), F.lit(" lifts "), F.col("company")),
        )
        .when(status == "O", F.concat(F.upper("company"), F.lit(" ships "), F.col("o_orderpriority")))
        .otherwise(F.concat(F.initcap("sub_industry"), F.lit(": talks with "), F.lower("ticker")))
        .alias("headline"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per customer, about itself, its neighbour, or the market."""
    segment = F.col("c_mktsegment")
    neighbour = F.concat(F.lit("C"), F.col("c_custkey") + 1)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("question_id"),
        F.when(segment == "BUILDING", F.lit("Show me the growth prediction for the market"))
        .when(
            segment == "MACHINERY",
            F.concat(F.lit("What about "), F.col("c_name"), F.lit(" and others?")),
        )
        .otherwise(
            F.concat(
                F.lit("What about "), F.col("c_name"), F.lit(" and "), neighbour,
                F.lit(" tomorrow?"),
            )
        )
        .alias("question"),
    )


def themes(spark: SparkSession) -> DataFrame:
    """The theme file as one JSON document."""
    return spark.range(1).select(F.lit(json.dumps(THEMES)).alias("document"))
