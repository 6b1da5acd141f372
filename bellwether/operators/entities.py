"""Company names: resolving, matching and finding them in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.functions.text import (
    QUESTION_FILLERS,
    clean_company_name,
    word_bounded,
    whole_word,
    word_tokens,
)
from bellwether.sources.readers import literal_rows
from bellwether.sources.steps import stored
from bellwether.operators.matching import (
    best_match,
    containing_pairs,
    overlapping_pairs,
    rarest_words,
    rounded,
    similar_pairs,
    substring_pairs,
)

# Everyday names and the listed name each one stands for.
COMMON_NAMES = {
    "google": "Alphabet Inc. (Class A)",
    "alphabet": "Alphabet Inc. (Class A)",
    "apple": "Apple Inc.",
    "microsoft": "Microsoft",
    "amazon": "Amazon",
    "nvidia": "Nvidia",
    "meta": "Meta Platforms",
    "tesla": "Tesla, Inc.",
}

# A whole-number score reaches s when the exact one is above s - 0.5.
FUZZY_LIST_SCORE = 80.5  # above 80
ALIAS_SCORE = 89.5  # at least 90
RESOLVE_SCORE = 94.5  # at least 95

# Weights of the combined name score, see _name_scores.
WORDS_WEIGHT = 0.95
CONTAINED_SCORE = 95.0
SUBSTRING_SCORE = 90.0


def _distinct_names(names: DataFrame, column: str) -> DataFrame:
    return names.select(column).filter(F.col(column).isNotNull()).distinct()


def fuzzy_match(
    names: DataFrame, official: DataFrame, name: str = "company", listed: str = "official"
) -> DataFrame:
    """Each distinct name with its listed name, as (name, listed, kind).

    Equal ignoring case first, else the highest edit ratio above 80. Names without
    a match are left out.
    """
    wanted = _distinct_names(names, name).withColumn("low", F.lower(name))
    by_low = (
        official.filter(F.col(listed).isNotNull())
        .groupBy(F.lower(listed).alias("listed_low"))
        .agg(F.min(listed).alias(listed))
    )
    lows = wanted.select("low").filter("low <> ''").distinct()
    equal = lows.join(by_low, lows["low"] == by_low["listed_low"]).select(
        "low", listed, F.lit("exact").alias("kind")
    )
    rest = lows.join(by_low, lows["low"] == by_low["listed_low"], "left_anti")
    pairs = similar_pairs(rest, by_low, FUZZY_LIST_SCORE, "low", "listed_low")
    near = best_match(
        pairs.join(by_low, "listed_low"), "low", listed, rounded(F.col("ratio"))
    ).select("low", listed, F.lit("fuzzy").alias("kind"))
    return wanted.join(equal.union(near), "low").select(name, listed, "kind")


def _name_scores(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str, bound: float
) -> DataFrame:
    """Scores of cleaned names above bound, as (left, right, score).

    The score of names with lengths within a factor 1.5 is the edit ratio, or 95
    when the words of one are among the words of the other, or 0.95 of the word-set
    score of names that share some of their words.
    """
    close = similar_pairs(left, right, bound, left_col, right_col).withColumn(
        "score", rounded(F.col("ratio"))
    )
    long, short = (
        F.greatest(F.length(left_col), F.length(right_col)),
        F.least(F.length(left_col), F.length(right_col)),
    )
    inside = containing_pairs(left, right, left_col, right_col).filter(
        long * 2 < short * 3
    )
    part = overlapping_pairs(left, right, left_col, right_col, bound / WORDS_WEIGHT)
    shared = part.withColumn("score", rounded(F.col("score") * WORDS_WEIGHT))
    return (
        close.select(left_col, right_col, "score")
        .union(inside.withColumn("score", F.lit(CONTAINED_SCORE)))
        .union(shared.select(left_col, right_col, "score"))
    )


def _listed(company_dim: DataFrame) -> DataFrame:
    """One row per cleaned official name; the largest name stands on a clash."""
    return (
        company_dim.select("company", "ticker", clean_company_name(F.col("company")).alias("clean"))
        .filter(F.col("clean") != "")
        .groupBy("clean")
        .agg(F.max_by(F.struct("company", "ticker"), "company").alias("c"))
        .select("clean", "c.company", "c.ticker")
    )


def common_names(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, COMMON_NAMES.items(), ["common", "official"])


def resolve_aliases(aliases: DataFrame, company_dim: DataFrame) -> DataFrame:
    """Aliases (common, official guess) with the listed name, as (common, company).

    The guess itself when it is listed, else the name with the same cleaned form,
    else the best match scoring at least 90, else the alias is dropped.
    """
    listed = stored(_listed(company_dim), "listed")
    names = company_dim.select(F.col("company").alias("same")).distinct()
    guesses = aliases.select(
        "common", "official", clean_company_name(F.col("official")).alias("guess")
    )
    same_form = listed.select(F.col("clean").alias("guess"), F.col("company").alias("by_form"))
    settled = guesses.join(names, F.col("official") == F.col("same"), "left").join(same_form, "guess", "left")
    settled = stored(settled, "guesses")
    is_open = F.col("same").isNull() & F.col("by_form").isNull() & (F.col("guess") != "")
    forms = settled.filter(is_open).select("guess").distinct()
    scored = (
        _name_scores(forms, listed, "guess", "clean", ALIAS_SCORE)
        .union(_reordered_scores(forms, listed))
        .union(_substring_scores(forms, listed))
    )
    found = best_match(scored, "guess", "clean", F.col("score")).join(
        listed.select("clean", F.col("company").alias("near")), "clean"
    )
    return (
        settled.join(found.select("guess", "near"), "guess", "left")
        .select("common", F.coalesce("same", "by_form", "near").alias("company"))
        .filter(F.col("company").isNotNull())
    )


def _reordered_scores(guesses: DataFrame, listed: DataFrame) -> DataFrame:
    """Names compared with their words in alphabetical order, weighted 0.95."""

    def ordered(name: str) -> Column:
        return F.array_join(F.array_sort(F.split(F.col(name), " ")), " ")

    left = guesses.withColumn("left_sorted", ordered("guess"))
    right = listed.select("clean").withColumn("right_sorted", ordered("clean"))
    pairs = similar_pairs(
        left.select("left_sorted").distinct(),
        right.select("right_sorted").distinct(),
        ALIAS_SCORE / WORDS_WEIGHT,
        "left_sorted",
        "right_sorted",
    )
    long, short = (
        F.greatest(F.length("guess"), F.length("clean")),
        F.least(F.length("guess"), F.length("clean")),
    )
    return (
        pairs.join(left, "left_sorted")
        .join(right, "right_sorted")
        .filter(long * 2 < short * 3)
        .select("guess", "clean", rounded(F.col("ratio") * WORDS_WEIGHT).alias("score"))
    )


def _substring_scores(guesses: DataFrame, listed: DataFrame) -> DataFrame:
    """Names of which one is a piece of the other, at 1.5 to 8 times the length."""
    names = listed.select("clean")
    inside = substring_pairs(names, guesses, "clean", "guess").select("guess", "clean")
    around = substring_pairs(guesses, names, "guess", "clean").select("guess", "clean")
    long, short = (
        F.greatest(F.length("guess"), F.length("clean")),
        F.least(F.length("guess"), F.length("clean")),
    )
    pairs = inside.union(around).filter((long * 2 >= short * 3) & (long <= short * 8))
    return pairs.withColumn("score", F.lit(SUBSTRING_SCORE))


def resolve_names(
    names: DataFrame,
    company_dim: DataFrame,
    aliases: DataFrame,
    name: str = "name",
    as_ticker: bool = True,
) -> DataFrame:
    """Each distinct name with its company, as (name, company); "" when unknown.

    A ticker in any case, else an alias (common, company), else the best listed
    name scoring at least 95. With as_ticker=False the last step gives the listed
    name in place of its ticker.
    """
    wanted = _distinct_names(names, name).select(
        name,
        F.upper(name).alias("upper"),
        clean_company_name(F.col(name)).alias("cleaned"),
    )
    tickers = company_dim.select(F.col("ticker").alias("upper")).distinct()
    alias_tickers = aliases.join(
        company_dim.groupBy("company").agg(F.min("ticker").alias("ticker")), "company"
    ).groupBy(F.col("common").alias("cleaned")).agg(F.min("ticker").alias("by_alias"))
    listed = stored(_listed(company_dim), "listed")
    settled = wanted.join(tickers.withColumn("by_ticker", F.col("upper")), "upper", "left").join(
        alias_tickers, "cleaned", "left"
    )
    # Every way of comparing reads the few open names again, so they are written once.
    settled = stored(settled, "settled")
    # Only names that neither a ticker nor an alias settles are compared.
    is_open = F.col("by_ticker").isNull() & F.col("by_alias").isNull() & (F.col("cleaned") != "")
    still_open = settled.filter(is_open).select("cleaned").distinct()
    scored = _name_scores(still_open, listed, "cleaned", "clean", RESOLVE_SCORE)
    shown = "ticker" if as_ticker else "company"
    found = best_match(scored, "cleaned", "clean", F.col("score")).join(
        listed.select("clean", F.col(shown).alias("near")), "clean"
    )
    return settled.join(found.select("cleaned", "near"), "cleaned", "left").select(
        name, F.coalesce("by_ticker", "by_alias", "near", F.lit("")).alias("company")
    )


def normalize_companies(
    mentions: DataFrame, company_dim: DataFrame, aliases: DataFrame, as_ticker: bool = True
) -> DataFrame:
    """Mentions with the company resolved, unresolved ones dropped.

    Each distinct name is resolved once and joined back.
    """
    named = mentions.withColumnRenamed("company", "raw")
    resolved = resolve_names(named, company_dim, aliases, "raw", as_ticker)
    kept = resolved.filter(F.col("company") != "")
    return named.join(kept, "raw").select(*mentions.columns)


def tickers_of(names: DataFrame, company_dim: DataFrame, name: str = "name") -> DataFrame:
    """Ticker of an official name or of a ticker, as (name, ticker); NULL if unknown."""
    keys = company_dim.select(F.col("company").alias(name), "ticker").union(
        company_dim.select("ticker", "ticker")
    )
    first = keys.groupBy(name).agg(F.min("ticker").alias("ticker"))
    return _distinct_names(names, name).join(first, name, "left")


def companies_of(tickers: DataFrame, company_dim: DataFrame) -> DataFrame:
    """Official name of a ticker in any case, as (ticker, company); NULL if unknown."""
    keys = company_dim.groupBy(F.col("ticker").alias("upper")).agg(
        F.min("company").alias("company")
    )
    return (
        _distinct_names(tickers, "ticker")
        .withColumn("upper", F.upper("ticker"))
        .join(keys, "upper", "left")
        .select("ticker", "company")
    )


def _name_keys(names: DataFrame, name: str, words: DataFrame) -> DataFrame:
    """Names with the rarest of their words in words(word), which any text holding the name holds too."""
    each = names.select(
        name, F.explode(F.array_distinct(word_tokens(F.col(name)))).alias("word")
    ).distinct()
    return names.join(rarest_words(each, name, words.select("word")), name)


def gazetteer_match(
    questions: DataFrame, known: DataFrame, key: str = "question_id",
    text: str = "question", name: str = "company",
) -> DataFrame:
    """Known names in each text, as (key, company).

    Whole words, longest name first; a matched name is removed before shorter names
    are tried. Texts and names meet on a word, so no text is tried against all names.
    """
    low = F.lower(F.col(text))
    words = questions.select(key, F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("word"))
    hits = words.join(_name_keys(known.select(name).distinct(), name, words), "word").select(key, name)
    in_text = (
        hits.join(questions.select(key, low.alias("low")), key)
        .filter(F.regexp_like("low", whole_word(F.col(name))))
        .groupBy(key)
        .agg(
            F.first("low").alias("low"),
            F.array_sort(
                F.collect_list(F.struct((-F.length(name)).alias("n"), F.col(name).alias("name")))
            ).alias("names"),
        )
    )
    start = F.struct(
        F.col("low").alias("rest"), F.array().cast("array<string>").alias("found")
    )

    def take(state: Column, entry: Column) -> Column:
        matched = F.regexp_like(state["rest"], whole_word(entry["name"]))
        shorter = F.replace(state["rest"], F.lower(entry["name"]), F.lit(""))
        return F.when(
            matched,
            F.struct(
                shorter.alias("rest"),
                F.array_append(state["found"], entry["name"]).alias("found"),
            ),
        ).otherwise(state)

    taken = F.aggregate("names", start, take)
    return in_text.select(key, F.explode(taken["found"]).alias(name))


def question_terms(
    questions: DataFrame, key: str = "question_id", text: str = "question"
) -> DataFrame:
    """Terms of a question that may name a company, as (key, term)."""
    terms = F.split(F.col(text), r"(?i)[\s,]+(?:and|or)?[\s,]*")
    trimmed = F.transform(terms, lambda t: F.trim(t))
    kept = F.filter(trimmed, lambda t: (t != "") & ~F.lower(t).isin(*QUESTION_FILLERS))
    return questions.select(key, F.explode(F.array_distinct(kept)).alias("term"))


def companies_in_questions(
    questions: DataFrame,
    known: DataFrame,
    company_dim: DataFrame,
    aliases: DataFrame,
    key: str = "question_id",
    text: str = "question",
    direct: DataFrame | None = None,
) -> DataFrame:
    """Companies a question asks about, as (key, company).

    Known names in the text (direct, where they have been looked up); only for
    questions without one, resolved terms.
    """
    if direct is None:
        direct = gazetteer_match(questions, known, key, text)
    silent = questions.join(direct, key, "left_anti")
    terms = question_terms(silent, key, text)
    resolved = resolve_names(terms, company_dim, aliases, name="term").filter("company <> ''")
    by_term = terms.join(resolved, "term").select(key, "company").distinct()
    return direct.union(by_term)


def name_list(company_dim: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names a headline can hold: official names, aliases and (in their case) tickers."""
    return (
        company_dim.select(
            F.col("company").alias("spelling"), F.lit(False).alias("as_written"), "ticker"
        )
        .union(
            aliases.join(company_dim, "company").select(
                "common", F.lit(False), "ticker"
            )
        )
        .union(company_dim.select("ticker", F.lit(True), "ticker"))
        .distinct()
    )


def _position(text: Column, spelling: Column, as_written: Column) -> Column:
    """Where a name first stands in a text as a whole word, 0 when it does not."""
    searched = F.when(as_written, text).otherwise(F.lower(text))
    looked = F.when(as_written, spelling).otherwise(F.lower(spelling))
    return F.regexp_instr(searched, word_bounded(looked))


def _earliest(headlines: DataFrame, names: DataFrame, key: str, headline: str, shown: str) -> DataFrame:
    """(key, place): the earliest known name of each headline, the longer one at one place, then the smaller shown.

    Words and names meet by a join that carries keys only, and the headline joins
    back where there is a candidate; a short name list is broadcast by its size.
    """
    words = headlines.select(
        key, F.explode(F.array_distinct(word_tokens(F.col(headline)))).alias("word")
    )
    hits = words.join(_name_keys(names, "spelling", words), "word").drop("word")
    position = _position(F.col(headline), F.col("spelling"), F.col("as_written"))
    place = F.struct(position.alias("position"), (-F.length("spelling")).alias("size"), F.col(shown))
    placed = hits.join(headlines.select(key, headline), key).select(key, place.alias("place"))
    return placed.filter(F.col("place.position") > 0).groupBy(key).agg(F.min("place").alias("place"))


def earliest_spelling(headlines: DataFrame, names: DataFrame, key: str, headline: str = "headline") -> DataFrame:
    """(key, spelling) of the earliest known name in each headline, for name lists (spelling, as_written) of any length.

    Each distinct headline is searched once, so rows of equal or no key stay apart.
    """
    digest = F.md5(headline).alias("digest")
    rows = headlines.filter(F.col(headline).isNotNull()).select(key, headline, digest)
    texts = rows.groupBy("digest").agg(F.first(headline).alias("text"))
    found = _earliest(texts, names, "digest", "text", "spelling")
    return rows.join(found, "digest").select(key, F.col("place.spelling").alias("spelling"))


def extract_company(
    headlines: DataFrame,
    names: DataFrame,
    key: str,
    headline: str = "headline",
) -> DataFrame:
    """Company of the earliest known name in a headline, as (key, company).

    Longer names win at the same place. Headlines without a known name are left out.
    """
    found = _earliest(headlines, names, key, headline, "ticker")
    return found.select(key, F.col("place.ticker").alias("company"))


def attach_companies(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions with the company found in their headline, NULL when none is.

    Each distinct headline is searched once and the result joins back by the
    headline's digest, so copies of one headline cost one search.
    """
    bare = mentions.drop("company")
    digest = F.md5("headline")
    headlines = (
        mentions.filter(F.col("headline").isNotNull())
        .groupBy(digest.alias("digest"))
        .agg(F.first("headline").alias("headline"))
    )
    found = extract_company(headlines, names, key="digest")
    return (
        bare.withColumn("digest", digest).join(found, "digest", "left").drop("digest")
    )
