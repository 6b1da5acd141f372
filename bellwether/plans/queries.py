"""Every operator as a named query over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwether.functions import labels
from bellwether.functions.decay import HOURS_RATE, SECONDS_RATE, decay, reference_time
from bellwether.functions.text import clean_company_name, join_headline_text, strip_inc
from bellwether.functions.values import to_number, to_timestamp
from bellwether.operators import (
    classifier,
    context,
    direction,
    entities,
    gazetteer,
    growth,
    increments,
    keywords,
    market,
    mentions,
    prices,
    recurrent,
    sentiment,
    sketch,
    stats,
    themes,
)
from bellwether.schemas import PREDICTIONS
from bellwether.session import prepare
from bellwether.sources import bindings, landed, readers, sinks
from bellwether.sources.prices import prices_of, write_price_table
from bellwether.sources.steps import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(prepare(spark), sf_dir)

    QUERIES[make.__name__] = run
    return run


def settle(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round doubles, as sums differ in their last bits with the order of addition."""
    return df.withColumns(
        {
            f.name: F.round(f.name, digits)
            for f in df.schema.fields
            if isinstance(f.dataType, T.DoubleType)
        }
    )


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.weigh_mentions(bindings.event_mentions(spark, d))


def _growth(spark: SparkSession, d: str) -> DataFrame:
    return growth.growth_from_mentions(
        bindings.event_mentions(spark, d), bindings.predictions(spark, d)
    )


def _headline_lists(spark: SparkSession, d: str) -> DataFrame:
    return mentions.headline_lists(bindings.text_mentions(spark, d), [F.col("event_id")])


def _top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return keywords.top_keywords(bindings.mentioned_texts(spark, d))


# Sources


@query
def scan_lenient(spark, d):
    raw = bindings.raw_event_mentions(spark, d)
    cells = [F.col(c).cast("string") for c in ("company", "sentiment", "confidence", "timestamp")]
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells])
    header = ["Company", "Sentiment", "Sentiment_Score", "Date"]
    parsed = readers.repair_columns(
        readers.parse_csv_lines(raw.select(line.alias("line")), "line", header)
    )
    return parsed.select(
        "company",
        "sentiment",
        to_number(F.col("sentiment_score")).alias("sentiment_score"),
        to_timestamp(F.col("timestamp")).alias("timestamp"),
    )


@query
def scan_files(spark, d):
    kept, _ = readers.scan_lines(spark, bindings.mention_files(spark, d), ["company", "timestamp"])
    return kept.select(
        "company",
        "sentiment",
        to_number(F.col("sentiment_score")).alias("sentiment_score"),
        to_timestamp(F.col("timestamp")).alias("timestamp"),
    )


@query
def scan_files_rejected(spark, d):
    _, rejected = readers.scan_lines(spark, bindings.mention_files(spark, d), ["company", "timestamp"])
    return rejected.groupBy("fields").agg(F.count("*").alias("lines"), F.max("line").alias("last_line"))


@query
def company_list(spark, d):
    # The named file is not there, so the next source counts, by the place of its columns.
    missing, found = f"{d}/no_such_list.csv", bindings.company_file(spark, d)
    listed = readers.read_or_else(
        lambda: spark.read.option("header", True).csv(missing),
        lambda: spark.read.option("header", True).csv(found),
    )
    named = readers.company_and_symbol(listed).withColumn("company", strip_inc(F.col("company")))
    return named.unionByName(readers.fallback_companies(spark).withColumn("company", strip_inc(F.col("company"))))


@query
def optional_source(spark, d):
    late = readers.read_or_empty(
        spark, lambda: readers.read_parquet(spark, f"{d}/late_predictions.parquet"), PREDICTIONS
    )
    return bindings.predictions(spark, d).unionByName(late)


@query
def flatten_json(spark, d):
    lines = F.split("description", "\n")
    articles = F.transform(
        lines,
        lambda line, at: F.struct(
            F.col("publishedAt"),
            F.col("title"),
            line.alias("description"),
            F.concat(F.col("url"), F.lit("#"), at).alias("url"),
            F.struct(F.col("company").alias("id"), F.upper("company").alias("name")).alias("source"),
        ),
    )
    payload = F.to_json(F.struct(articles.alias("articles"), F.col("company").alias("keyword")))
    parsed = bindings.news(spark, d).select(landed.parse_news(payload).alias("p"))
    return landed.typed_news(landed.news_rows(parsed.select("p.*")))


@query
def cap_per_source(spark, d):
    newest = [F.desc("created_utc"), F.col("conv_id"), F.col("turn")]
    return landed.cap_per_source(bindings.posts(spark, d), newest).select(
        "subreddit", "conv_id", "turn", "created_utc", "title"
    )


@query
def post_rows(spark, d):
    return landed.post_rows(bindings.posts(spark, d))


@query
def price_range_scan(spark, d):
    return bindings.prices(spark, d, "1996-01-01", "1998-01-01")


@query
def news_listing(spark, d):
    docs = bindings.table(spark, d, "documents")
    article = F.struct(
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("snippet"),
        F.col("source"),
        F.concat(F.lit("day "), F.col("doc_id")).alias("date"),
        F.col("lang").alias("formatted_date"),
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"),
    )
    parsed = docs.select(landed.parse_listing(F.to_json(article)).alias("a"))
    return landed.news_listing(parsed.select("a.*"))


# Merging


@query
def merge_sources(spark, d):
    return mentions.merge_sources(bindings.news(spark, d), bindings.posts(spark, d))


@query
def merge_sources_tolerant(spark, d):
    return mentions.merge_with_sentiment(
        bindings.news(spark, d), bindings.posts(spark, d).drop("url"), None
    )


@query
def attach_sentiment(spark, d):
    merged = mentions.merge_with_sentiment(
        bindings.news(spark, d), bindings.posts(spark, d), bindings.labelled_news(spark, d)
    )
    return merged.drop("text")


@query
def normalize_filter(spark, d):
    raw = bindings.raw_event_mentions(spark, d)
    return mentions.with_company(raw).select("event_id", "company", "sentiment")


@query
def latest_headlines(spark, d):
    rows = bindings.text_mentions(spark, d)
    return mentions.latest_headlines(rows, [F.col("event_id")]).select(
        "event_id", "timestamp", "headline"
    )


@query
def top_headlines_per_company(spark, d):
    return _headline_lists(spark, d).select(
        "company_key", F.array_join("headlines", "; ").alias("headlines")
    )


# Sentiment


@query
def decay_weight(spark, d):
    rows = bindings.event_mentions(spark, d)
    moment = reference_time(rows)
    return settle(
        rows.select(
            "event_id",
            decay(F.col("timestamp"), moment, SECONDS_RATE).alias("by_seconds"),
            decay(F.col("timestamp"), moment, HOURS_RATE, "hours").alias("by_hours"),
        )
    )


@query
def weighted_mentions(spark, d):
    columns = ["event_id", "sentiment_score", "time_decay_weight", "weighted_sentiment"]
    return settle(_weighted(spark, d).select(*columns))


@query
def company_sentiment(spark, d):
    return settle(sentiment.company_sentiment(_weighted(spark, d)))


@query
def company_mentions(spark, d):
    return sentiment.company_mentions(bindings.event_mentions(spark, d))


@query
def decayed_mean(spark, d):
    return settle(sentiment.decayed_sentiment(_weighted(spark, d)))


@query
def label_pivot(spark, d):
    return sentiment.label_counts(bindings.event_mentions(spark, d))


@query
def sector_sentiment(spark, d):
    return settle(
        sentiment.sector_sentiment(
            sentiment.company_sentiment(_weighted(spark, d)), bindings.company_sectors(spark, d)
        )
    )


@query
def label_map7(spark, d):
    kind = F.col("event_type")
    label = (
        F.when(kind == "purchase", F.lit("Very_Positive"))
        .when(kind == "signup", F.lit("slightly_positive"))
        .when(kind == "error", F.lit("NEGATIVE"))
        .when(kind == "view", F.lit("mixed"))
    )
    return bindings.table(spark, d, "events").select(
        "event_id", labels.graded_label_score(label).alias("sentiment_score")
    )


@query
def lexicon_weights(spark, d):
    return bindings.lexicon(spark, d)


@query
def lexicon_score(spark, d):
    docs = bindings.table(spark, d, "documents").select("doc_id", "text")
    return settle(sentiment.lexicon_scores(docs, bindings.lexicon(spark, d), "doc_id"))


@query
def sentiment_lexicon(spark, d):
    articles = bindings.news(spark, d).select(
        "doc_id", join_headline_text(F.col("title"), F.col("description")).alias("text")
    )
    scores = sentiment.lexicon_scores(articles, bindings.lexicon(spark, d), "doc_id")
    label, confidence = sentiment.graded(F.col("lexicon_score"))
    return settle(scores.select("doc_id", label.alias("sentiment"), confidence.alias("confidence")))


def _fitted(spark: SparkSession, d: str):
    texts = bindings.labelled_texts(spark, d)
    return classifier.fit(texts.filter(~classifier.held_out(F.col("doc_id"))))


@query
def label_classifier(spark, d):
    docs = bindings.table(spark, d, "documents").select("doc_id", "text")
    return settle(classifier.classified(docs, _fitted(spark, d), "doc_id"), 6)


@query
def held_out_labels(spark, d):
    texts = bindings.labelled_texts(spark, d).filter(classifier.held_out(F.col("doc_id")))
    return texts.groupBy("sentiment").agg(F.count("*").alias("documents"))


@query
def classifier_accuracy(spark, d):
    texts = bindings.labelled_texts(spark, d).filter(classifier.held_out(F.col("doc_id")))
    scores = sentiment.lexicon_scores(texts, bindings.lexicon(spark, d), "doc_id")
    by_lexicon = scores.select("doc_id", sentiment.graded(F.col("lexicon_score"))[0].alias("sentiment"))
    by_model = classifier.classified(texts, _fitted(spark, d), "doc_id")
    rows = [
        classifier.accuracy(told, texts, "doc_id").withColumn("method", F.lit(name))
        for name, told in (("classifier", by_model), ("lexicon", by_lexicon))
    ]
    return settle(rows[0].unionByName(rows[1]), 6)


def _series_points(series: DataFrame) -> DataFrame:
    points = F.posexplode(F.arrays_zip("dates", "sentiment_scores")).alias("position", "p")
    return series.select("name", points).select(
        "name", "position", F.col("p.dates").alias("date"), F.col("p.sentiment_scores").alias("score")
    )


@query
def company_series(spark, d):
    daily = sentiment.daily_sentiment(_weighted(spark, d))
    return _series_points(sentiment.company_series(settle(daily)))


@query
def company_series_chosen(spark, d):
    daily = sentiment.daily_sentiment(_weighted(spark, d))
    return _series_points(sentiment.company_series(settle(daily), "C1, C3 ,C5,C7, none"))


@query
def market_series(spark, d):
    return settle(sentiment.market_series(_weighted(spark, d)))


@query
def score_summary(spark, d):
    return settle(stats.summary(_weighted(spark, d), "sentiment_score"))


@query
def label_value_counts(spark, d):
    return stats.value_counts(bindings.event_mentions(spark, d), "sentiment")


# Keywords and themes


@query
def top_keywords(spark, d):
    return _top_keywords(spark, d)


@query
def cms_keywords(spark, d):
    rows = bindings.mentioned_texts(spark, d)
    wanted = _top_keywords(spark, d)
    built = sketch.build_sketch(keywords.keyword_feed(rows, wanted), amount=F.col("times"))
    return sketch.estimate(built, wanted).orderBy(F.desc("count"), "keyword")


@query
def cms_wide(spark, d):
    docs = bindings.table(spark, d, "documents")
    built = sketch.build_sketch(keywords.keyword_rows(docs, "text"), **sketch.WIDE)
    wanted = keywords.top_keywords(docs, "text")
    return sketch.estimate(built, wanted, **sketch.WIDE)


@query
def cms_builtin(spark, d):
    rows = bindings.text_mentions(spark, d)
    feed = keywords.keyword_feed(rows, _top_keywords(spark, d))
    return sketch.builtin_sketch(feed)


@query
def edw_keywords(spark, d):
    rows = bindings.mentioned_texts(spark, d)
    return settle(keywords.decayed_keywords(rows, _top_keywords(spark, d)))


@query
def theme_sentiment(spark, d):
    pairs = landed.theme_keywords(bindings.themes(spark), "document")
    return themes.theme_sentiment(bindings.mentioned_texts(spark, d), pairs)


# Growth


@query
def growth_score(spark, d):
    return settle(_growth(spark, d))


@query
def growth_from_tables(spark, d):
    weighted = _weighted(spark, d)
    signals = growth.join_signals(
        sentiment.company_sentiment(weighted), sentiment.decayed_sentiment(weighted)
    )
    return settle(growth.growth_score(signals, bindings.predictions(spark, d)))


@query
def top_growth(spark, d):
    return settle(growth.top(_growth(spark, d), "growth_score", 5))


@query
def top_bottom(spark, d):
    return settle(growth.top_and_bottom(_growth(spark, d)))


@query
def fuse_scores(spark, d):
    return settle(
        growth.fuse_scores(
            sentiment.company_sentiment(_weighted(spark, d)), bindings.predictions(spark, d)
        )
    )


@query
def top3_fused(spark, d):
    fused = growth.fuse_scores(
        sentiment.company_sentiment(_weighted(spark, d)), bindings.predictions(spark, d)
    )
    return settle(growth.top(fused, "final_score", 3))


@query
def fused_lines(spark, d):
    fused = growth.fuse_scores(
        sentiment.company_sentiment(_weighted(spark, d)), bindings.predictions(spark, d)
    )
    return fused.select("company", context.fused_line().alias("line"))


@query
def growth_score_100(spark, d):
    mood = market.market_mood(
        bindings.market_index(spark, d), bindings.volatility_index(spark, d)
    )
    return settle(growth.growth_score_100(_weighted(spark, d), mood.scalar()))


@query
def market_label(spark, d):
    market_value = _growth(spark, d).agg(F.max("market_sentiment").alias("market_sentiment"))
    return settle(
        market_value.select(
            "market_sentiment", labels.market_label(F.col("market_sentiment")).alias("label")
        )
    )


@query
def mention_labels(spark, d):
    return _weighted(spark, d).select(
        "event_id", labels.market_label(F.col("sentiment_score")).alias("label")
    )


@query
def update_join(spark, d):
    held = bindings.company_sectors(spark, d).withColumn("ml_prediction", F.lit("none yet"))
    fresh = bindings.predictions(spark, d).withColumn(
        "ml_prediction", F.nullif(F.col("ml_prediction"), F.lit("neutral"))
    )
    return growth.update_column(held, fresh)


@query
def known_companies(spark, d):
    return growth.known_companies(
        sentiment.company_sentiment(_weighted(spark, d)), bindings.predictions(spark, d)
    )


@query
def companies_intersect(spark, d):
    return growth.companies_in_both(
        sentiment.company_mentions(bindings.event_mentions(spark, d)),
        bindings.predictions(spark, d),
    )


@query
def companies_except(spark, d):
    return growth.company_differences(
        sentiment.company_mentions(bindings.event_mentions(spark, d)),
        bindings.predictions(spark, d),
    )


# Prices


@query
def price_features(spark, d):
    wanted = ["ticker", "trade_date", "price_change", "ma_5", "ma_10", "target"]
    return settle(prices.price_features(bindings.prices(spark, d)).select(*wanted), 4)


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    scores = sentiment.company_sentiment(_weighted(spark, d))
    return direction.model_rows(bindings.prices(spark, d), scores)


@query
def scaled_features(spark, d):
    wanted = ["ticker", "trade_date", "ma_5", "ma_10", "sentiment", "target"]
    return settle(_scaled(spark, d).select(*wanted))


@query
def sequences(spark, d):
    rows = prices.sequences(_scaled(spark, d))
    cells = [
        F.get("steps", F.lit(at))[name].alias(f"{name}_{at}")
        for at in range(prices.STEPS)
        for name in prices.FEATURES
    ]
    return settle(rows.select("ticker", "trade_date", "target", *cells))


@query
def latest_sequences(spark, d):
    rows = prices.latest_sequences(_scaled(spark, d))
    cells = [
        F.get("steps", F.lit(at))[name].alias(f"{name}_{at}")
        for at in range(prices.STEPS)
        for name in prices.FEATURES
    ]
    return settle(rows.select("ticker", "trade_date", *cells))


@query
def sma_latest(spark, d):
    return settle(prices.latest_averages(bindings.prices(spark, d)), 4)


@query
def latest_quote(spark, d):
    return settle(prices.latest_quotes(bindings.prices(spark, d)), 4)


@query
def market_mood(spark, d):
    return settle(
        market.market_mood(bindings.market_index(spark, d), bindings.volatility_index(spark, d))
    )


@query
def market_returns(spark, d):
    # One row per order: the operator itself makes one close of each day.
    orders = bindings.table(spark, d, "orders")
    series = orders.select(
        F.col("o_orderdate").cast("timestamp").alias("trade_date"), F.col("o_totalprice").alias("close")
    )
    return settle(market.daily_returns(series), 6)


@query
def signals_by_day(spark, d):
    # All days but the newest first, then the newest alone: only its partial sums are made anew.
    rows = bindings.event_mentions(spark, d)
    newest = rows.agg(F.max(F.to_date("timestamp"))).scalar()
    is_new = F.coalesce(F.to_date("timestamp") >= newest, F.lit(False))
    path = new_path(spark, "partials")
    increments.write_days(rows.filter(~is_new), path)
    increments.write_days(rows.filter(is_new), path)
    return settle(increments.signals(spark, path, reference_time(rows)))


@query
def market_indicators(spark, d):
    return settle(
        market.market_indicators(
            bindings.market_index(spark, d), bindings.volatility_index(spark, d)
        ),
        4,
    )


@query
def market_indicators_30_days(spark, d):
    return settle(
        market.market_indicators(
            market.recent_days(bindings.market_index(spark, d)),
            market.recent_days(bindings.volatility_index(spark, d)),
        ),
        4,
    )


@query
def direction_split(spark, d):
    scores = sentiment.company_sentiment(_weighted(spark, d))
    rows = direction.model_rows(bindings.prices(spark, d), scores)
    return settle(direction.split_summary(prices.sequences(rows)))


@query
def predict_direction(spark, d):
    scores = sentiment.company_sentiment(_weighted(spark, d))
    return direction.predict_direction(bindings.prices(spark, d), scores)


@query
def direction_accuracy(spark, d):
    scores = sentiment.company_sentiment(_weighted(spark, d))
    return direction.direction_accuracy(bindings.prices(spark, d), scores)


@query
def direction_area(spark, d):
    scores = sentiment.company_sentiment(_weighted(spark, d))
    return settle(direction.direction_area(bindings.prices(spark, d), scores), 6)


@query
def predict_recurrent(spark, d):
    scores = sentiment.company_sentiment(_weighted(spark, d))
    return recurrent.predict_recurrent(bindings.prices(spark, d), scores)


@query
def direction_models(spark, d):
    scores = sentiment.company_sentiment(_weighted(spark, d))
    return settle(recurrent.compared_models(bindings.prices(spark, d), scores), 6)


@query
def sentiment_area(spark, d):
    # How well the confidence of an event's mention tells rising kinds from the others.
    rows = bindings.event_mentions(spark, d)
    label = (F.col("sentiment") == "positive").cast("int")
    score = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    return settle(direction.area_under_curve(rows.select(score.alias("score"), label.alias("label"))))


@query
def prices_of_movers(spark, d):
    # The written table is read for the predicted risers only.
    path = new_path(spark, "prices")
    write_price_table(bindings.prices(spark, d), path)
    risers = bindings.predictions(spark, d).filter("ml_prediction = 'up'")
    bars = prices_of(spark, path, risers.select(F.col("company").alias("ticker")), "1995-01-01")
    return settle(bars.groupBy("ticker").agg(F.count("*").alias("days"), F.max("high").alias("high")), 4)


# Names


@query
def clean_name(spark, d):
    return bindings.part_spellings(spark, d).select(
        "p_partkey", clean_company_name(F.col("name")).alias("clean")
    )


@query
def name_mapping(spark, d):
    spellings = bindings.part_spellings(spark, d)
    return sinks.name_audit(
        spellings.withColumn("normalized_company", clean_company_name(F.col("name"))), "name"
    )


@query
def fuzzy_match(spark, d):
    official = bindings.part_companies(spark, d).select(F.col("company").alias("official"))
    return entities.fuzzy_match(bindings.part_spellings(spark, d), official, name="name")


def _part_aliases(spark: SparkSession, d: str) -> DataFrame:
    return entities.resolve_aliases(
        bindings.part_aliases(spark, d), bindings.part_companies(spark, d)
    )


@query
def alias_resolve(spark, d):
    return _part_aliases(spark, d)


@query
def normalize_company(spark, d):
    return entities.resolve_names(
        bindings.part_spellings(spark, d),
        bindings.part_companies(spark, d),
        _part_aliases(spark, d),
    )


@query
def normalize_mentions(spark, d):
    spelt = bindings.part_spellings(spark, d).withColumnRenamed("name", "company")
    return entities.normalize_companies(
        spelt, bindings.part_companies(spark, d), _part_aliases(spark, d), as_ticker=False
    )


@query
def ticker_lookup(spark, d):
    companies = bindings.company_dim(spark, d)
    names = companies.select(F.col("company").alias("name")).union(
        bindings.predictions(spark, d).select("company")
    )
    return entities.tickers_of(names, companies)


@query
def company_lookup(spark, d):
    tickers = bindings.event_mentions(spark, d).select(F.lower("company").alias("ticker"))
    return entities.companies_of(tickers, bindings.company_dim(spark, d))


@query
def question_terms(spark, d):
    return entities.question_terms(bindings.questions(spark, d))


@query
def nested_names(spark, d):
    asked, names = bindings.part_questions(spark, d), bindings.part_names(spark, d)
    return gazetteer.names_in_texts(asked, names, key="p_partkey")


@query
def gazetteer_match(spark, d):
    return gazetteer.names_in_texts(
        bindings.questions(spark, d), sentiment.company_mentions(bindings.event_mentions(spark, d))
    )


def _asked(spark: SparkSession, d: str) -> DataFrame:
    # Names in the text, else resolved terms; nations stand in for everyday names.
    questions = bindings.questions(spark, d)
    known = sentiment.company_mentions(bindings.event_mentions(spark, d))
    return entities.companies_in_questions(
        questions,
        known,
        bindings.company_dim(spark, d),
        bindings.nation_aliases(spark, d),
        direct=stored(gazetteer.names_in_texts(questions, known), "direct"),
    )


@query
def companies_in_questions(spark, d):
    return _asked(spark, d)


@query
def extract_company(spark, d):
    names = entities.name_list(bindings.company_dim(spark, d), bindings.nation_aliases(spark, d))
    return entities.extract_company(
        bindings.order_headlines(spark, d), names, key="o_orderkey"
    )


@query
def extract_resolved(spark, d):
    return gazetteer.resolved_companies(
        bindings.order_headlines(spark, d),
        bindings.company_dim(spark, d),
        bindings.nation_aliases(spark, d),
        key="o_orderkey",
    )


# Context


@query
def join_ci(spark, d):
    lowered = bindings.predictions(spark, d).withColumn("company", F.lower("company"))
    return settle(
        context.join_ignoring_case(
            lowered, sentiment.company_sentiment(_weighted(spark, d))
        )
    )


@query
def join_theme_optional(spark, d):
    companies = bindings.company_sectors(spark, d)
    scores = sentiment.sector_sentiment(
        sentiment.company_sentiment(_weighted(spark, d)), companies
    ).toDF("theme", "macro_sentiment_score")
    themed = companies.withColumnRenamed("sector", "theme")
    with_theme = context.join_theme(themed, scores)
    without = context.join_theme(companies, scores).withColumnRenamed("sector", "theme")
    return settle(
        with_theme.select("company", "theme", "macro_sentiment_score").union(
            without.select("company", F.lit(None).cast("string"), "macro_sentiment_score")
        )
    )


@query
def context_select(spark, d):
    grown = stored(_growth(spark, d), "growth")
    return settle(context.select_context(bindings.questions(spark, d), _asked(spark, d), grown))


def _details(spark: SparkSession, d: str, grown: DataFrame) -> DataFrame:
    sectors = bindings.company_sectors(spark, d)
    # The growth table has the sentiment of every company, so its means per sector need no further scan.
    scores = grown.select("company", F.col("sentiment_score").alias("normalized_sentiment"))
    themes = sentiment.sector_sentiment(scores, sectors).toDF("theme", "macro_sentiment_score")
    labels = sentiment.label_counts(bindings.event_mentions(spark, d))
    return context.company_details(
        grown,
        labels.join(sectors.withColumnRenamed("sector", "theme"), "company", "left"),
        bindings.company_dim(spark, d),
        prices.latest_quotes(bindings.prices(spark, d)),
        _headline_lists(spark, d),
        themes,
    )


@query
def company_context(spark, d):
    grown = stored(_growth(spark, d), "growth")
    chosen = context.select_context(bindings.questions(spark, d), _asked(spark, d), grown)
    shown = context.company_context(chosen, _details(spark, d, grown))
    return settle(shown.withColumn("headlines", F.array_join("headlines", "; ")), 4)


@query
def context_lines(spark, d):
    grown = stored(_growth(spark, d), "growth")
    return _details(spark, d, grown).select("company", context.context_line().alias("line"))
