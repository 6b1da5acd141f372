"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from bellwether.functions.text import LEGAL_FORMS, QUESTION_FILLERS, STOP_WORDS
from bellwether.operators.prices import FEATURES, STEPS
from bellwether.sources.bindings import LEXICON_WORDS, THEMES
from bellwether.sources.readers import FALLBACK_COMPANIES

WORD = r"[\p{L}\p{N}_]+"


def _texts(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# Inputs

RAW_EVENTS = """
raw_ev AS (
  SELECT event_id,
    ts AS "timestamp", event_type || ' ' || props AS headline, 'C' || user_id AS company,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
         WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment,
    value / 1000 AS confidence, value
  FROM events)"""

EVENTS = RAW_EVENTS + """,
ev AS (
  SELECT event_id, "timestamp", headline, nullif(company, '') AS company, sentiment, confidence
  FROM raw_ev),
aged AS (
  SELECT *, (now_us - epoch_us("timestamp")) / 1e6 AS age_s,
    CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END * confidence
      AS sentiment_score
  FROM ev, (SELECT epoch_us(max("timestamp")) AS now_us FROM ev)),
weighted AS (
  SELECT *, coalesce(exp(-1e-5::double * age_s), 0) AS time_decay_weight,
    coalesce(exp(-0.01::double * (age_s / 3600.0::double)), 0) AS slow_weight,
    sentiment_score * time_decay_weight AS weighted_sentiment
  FROM aged)"""

SENTIMENT = EVENTS + """,
cs AS (
  SELECT company, coalesce(sum(weighted_sentiment), 0) AS weighted_sentiment_sum,
    count(headline) AS article_count,
    coalesce(sum(weighted_sentiment), 0) / nullif(count(headline), 0) AS normalized_sentiment
  FROM weighted WHERE company IS NOT NULL GROUP BY company),
dm AS (
  SELECT company, avg(sentiment_score * slow_weight) AS time_decayed_sentiment,
    count(*) AS total_mentions
  FROM weighted WHERE company IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY company)"""

PREDICTIONS = """
pred AS (
  SELECT 'C' || s_suppkey AS company,
    CASE WHEN s_acctbal > 6000 THEN 'up' WHEN s_acctbal > 3000 THEN 'down' ELSE 'neutral' END
      AS ml_prediction
  FROM supplier)"""

FUSED = SENTIMENT + "," + PREDICTIONS + """,
fused AS (
  SELECT cs.*, ml_prediction, CASE WHEN ml_prediction = 'up' THEN 1 ELSE -1 END
    AS ml_prediction_score, normalized_sentiment + ml_prediction_score AS final_score
  FROM cs LEFT JOIN pred USING (company))"""

GROWTH = SENTIMENT + "," + PREDICTIONS + """,
g0 AS (
  SELECT company, normalized_sentiment AS s, coalesce(time_decayed_sentiment, 0) AS d,
    coalesce(ml_prediction, 'neutral') AS ml_prediction, coalesce(total_mentions, 0) AS total_mentions
  FROM cs LEFT JOIN dm USING (company) LEFT JOIN pred USING (company)),
b AS (SELECT min(s) AS s0, max(s) AS s1, min(d) AS d0, max(d) AS d1 FROM g0),
growth AS (
  SELECT company, s AS sentiment_score, d AS time_decayed_sentiment, ml_prediction,
    0.40::double * CASE WHEN s1 = s0 THEN 0 ELSE (s - s0) / (s1 - s0) * 2 - 1 END
    + 0.35::double * CASE WHEN d1 = d0 THEN 0 ELSE (d - d0) / (d1 - d0) * 2 - 1 END
    + 0.25::double * CASE ml_prediction WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END
      AS growth_score,
    (SELECT avg(time_decayed_sentiment) FROM dm) AS market_sentiment, total_mentions
  FROM g0, b)"""

DOCS = """
art AS (
  SELECT doc_id, coalesce(nullif(split_part(text, chr(10), 1), ''), text) AS headline, text,
    'doc:' || doc_id AS url, source
  FROM documents)"""

TEXTS = EVENTS + "," + DOCS + """,
tm AS (
  SELECT w.event_id, w."timestamp", w.company, w.sentiment, w.age_s, art.headline, art.text, art.source
  FROM weighted w JOIN art ON art.doc_id = w.event_id % (SELECT count(*) FROM documents))"""

HEADLINES = TEXTS + """,
ranked AS (
  SELECT upper(company) AS company_key, headline, row_number() OVER (
    PARTITION BY upper(company) ORDER BY "timestamp" DESC NULLS LAST, event_id) AS rn
  FROM tm WHERE company IS NOT NULL),
heads AS (
  SELECT company_key, string_agg(headline, '; ' ORDER BY rn) AS headlines
  FROM ranked WHERE rn <= 3 GROUP BY company_key)"""

NEWS = """
news AS (
  SELECT doc_id, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS published,
    coalesce(nullif(split_part(text, chr(10), 1), ''), text) AS headline,
    text AS body,
    'doc:' || doc_id AS url, source
  FROM documents),
post AS (
  SELECT conv_id, turn, role, 1704067200.0::double + conv_id * 60 + turn AS created_utc,
    coalesce(nullif(split_part(text, chr(10), 1), ''), text) AS headline, text,
    'conv:/' || conv_id || '/' || turn AS url
  FROM conversations)"""

MERGED = NEWS + """,
merged AS (
  SELECT published AS "timestamp", headline, body AS text, 'news' AS source, url, source AS company
  FROM news WHERE headline <> '' AND body <> ''
  UNION ALL
  SELECT make_timestamp((created_utc * 1000000)::bigint), headline, text, 'reddit', url, NULL
  FROM post WHERE headline <> '' AND text <> '')"""


def _bars(where: str = "") -> str:
    return f"""
bars AS (
  SELECT 'C' || l_suppkey AS ticker, date_trunc('day', l_shipdate)::timestamp AS trade_date,
    arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS close,
    sum(l_quantity)::bigint AS volume
  FROM lineitem {where} GROUP BY ALL)"""


BARS = _bars()

FEATURE_ROWS = BARS + """,
lagged AS (
  SELECT ticker, trade_date, close,
    close - lag(close) OVER t AS price_change,
    CASE WHEN count(*) OVER f5 = 5 THEN avg(close) OVER f5 END AS ma_5,
    CASE WHEN count(*) OVER f10 = 10 THEN avg(close) OVER f10 END AS ma_10,
    CASE WHEN lead(close) OVER t - close > 0 THEN 1 ELSE 0 END AS target,
    lead(trade_date) OVER t IS NULL AS is_last
  FROM bars
  WINDOW t AS (PARTITION BY ticker ORDER BY trade_date),
    f5 AS (PARTITION BY ticker ORDER BY trade_date ROWS 4 PRECEDING),
    f10 AS (PARTITION BY ticker ORDER BY trade_date ROWS 9 PRECEDING)),
features AS (
  SELECT * FROM lagged
  WHERE price_change IS NOT NULL AND ma_5 IS NOT NULL AND ma_10 IS NOT NULL)"""

SCALED = SENTIMENT + "," + FEATURE_ROWS + """,
joined AS (
  SELECT f.*, coalesce(normalized_sentiment, 0) AS raw_sentiment
  FROM features f LEFT JOIN cs ON cs.company = f.ticker),
scaled AS (
  SELECT ticker, trade_date, target, is_last,
    CASE WHEN max(ma_5) OVER p = min(ma_5) OVER p THEN 0
      ELSE (ma_5 - min(ma_5) OVER p) / (max(ma_5) OVER p - min(ma_5) OVER p) END AS ma_5,
    CASE WHEN max(ma_10) OVER p = min(ma_10) OVER p THEN 0
      ELSE (ma_10 - min(ma_10) OVER p) / (max(ma_10) OVER p - min(ma_10) OVER p) END AS ma_10,
    0.0::double AS sentiment
  FROM joined WINDOW p AS (PARTITION BY ticker))"""


def _steps(first: int) -> str:
    cells = [
        f"round(lag({name}, {STEPS - 1 - at + first}) OVER t, 9) AS {name}_{at}"
        for at in range(STEPS)
        for name in FEATURES
    ]
    return ", ".join(cells)


QUOTES = """
newest AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS age FROM bars),
quotes AS (
  SELECT ticker, max(trade_date) FILTER (age = 1) AS trade_date,
    coalesce(max(close) FILTER (age = 1), max(close) FILTER (age = 2)) AS current_price,
    max(close) FILTER (age = 2) AS previous_close,
    max(high) FILTER (age = 1) AS day_high, max(low) FILTER (age = 1) AS day_low,
    max(volume) FILTER (age = 1) AS volume,
    CASE WHEN count(*) FILTER (age <= 20) = 20 THEN avg(close) FILTER (age <= 20) END AS sma_20,
    CASE WHEN count(*) FILTER (age <= 50) = 50 THEN avg(close) FILTER (age <= 50) END AS sma_50
  FROM newest GROUP BY ticker)"""


def _market(days: int | None = None) -> str:
    recent = (
        f"WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL {days} DAY"
        if days
        else ""
    )
    return f"""
days AS (
  SELECT date_trunc('day', o_orderdate) AS trade_date, avg(o_totalprice) AS index_close,
    max(o_totalprice) AS vix_close
  FROM orders {recent} GROUP BY ALL),
moves AS (
  SELECT *, index_close / lag(index_close) OVER (ORDER BY trade_date) - 1 AS change,
    row_number() OVER (ORDER BY trade_date DESC) AS age
  FROM days)"""


MOOD = _market() + """,
level AS (
  SELECT arg_max(vix_close, trade_date) AS last, avg(vix_close) AS mean,
    stddev_pop(vix_close) AS spread, count(*) AS n FROM days),
trend AS (
  SELECT avg(change) FILTER (age <= 4) * 100 AS r5, avg(change) FILTER (age <= 19) * 100 AS r20
  FROM moves),
mood AS (
  SELECT CASE WHEN n < 20 THEN 0 ELSE greatest(-1, least(1,
      0.4::double * CASE WHEN spread > 0 THEN -tanh((last - mean) / spread) ELSE 0 END
      + 0.4::double * tanh(coalesce(r5, 0) / 5) + 0.2::double * tanh(coalesce(r20, 0) / 10))) END
      AS market_sentiment
  FROM level, trend)"""


# Text


def _word_tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD}')"


def _space_tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[\\s\\p{{Z}}\\x0B\\x85]+'), lambda t: t <> '')"


_STOPS = _texts(w for w in STOP_WORDS if len(w) > 3)


def _top_words(source: str, column: str) -> str:
    return f"""
words AS (SELECT unnest({_word_tokens(column)}) AS keyword FROM {source}),
top_words AS (
  SELECT keyword, count(*) AS frequency FROM words
  WHERE length(keyword) > 3 AND keyword NOT IN ({_STOPS})
  GROUP BY keyword ORDER BY frequency DESC, keyword LIMIT 100)"""


def _sketch(feed: str, width: int, depth: int) -> str:
    cells = f"""
  SELECT keyword, d AS depth,
    (('0x' || substr(md5(keyword), 1, 8))::bigint
      + d * ('0x' || substr(md5(keyword), 9, 8))::bigint) % {width} AS bucket
  FROM {{source}}, range(0, {depth}) r(d)"""
    return f"""
cells AS ({cells.format(source=feed)}),
grid AS (SELECT depth, bucket, count(*) AS n FROM cells GROUP BY ALL),
asked AS ({cells.format(source="top_words")}),
estimates AS (
  SELECT keyword, min(coalesce(n, 0))::bigint AS "count"
  FROM asked LEFT JOIN grid USING (depth, bucket) GROUP BY keyword)"""


LEXICON = f"""
held AS (
  SELECT quality, unnest(list_distinct({_word_tokens("text")})) AS keyword
  FROM labels JOIN documents USING (doc_id)),
lexicon AS (
  SELECT keyword, round(ln((count(*) FILTER (quality = 1) + 1)
    / (count(*) FILTER (quality = 0) + 1)::double), 6) AS weight
  FROM held WHERE length(keyword) >= 4 GROUP BY keyword
  ORDER BY count(*) FILTER (quality IN (0, 1)) DESC, keyword LIMIT {LEXICON_WORDS})"""


def _lexicon(column: str, source: str) -> str:
    return f"""
found AS (SELECT doc_id, unnest({_word_tokens(column)}) AS keyword FROM {source}),
lexicon_sums AS (SELECT doc_id, sum(weight) AS s FROM found JOIN lexicon USING (keyword) GROUP BY doc_id),
lexicon_scored AS (
  SELECT doc_id, round(coalesce(s, 0), 9) AS s FROM {source} LEFT JOIN lexicon_sums USING (doc_id))"""


def _themes() -> str:
    rows = [
        f"('{word.lower()}', '{theme}')" for theme, words in THEMES.items() for word in words
    ]
    return f"themes(keyword, theme) AS (VALUES {', '.join(rows)})"


# Names


def _clean(column: str) -> str:
    spaced = f"regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    bare = f"regexp_replace({spaced}, '\\b({'|'.join(LEGAL_FORMS)})\\b', '', 'g')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


def _lcs(a: str, b: str) -> str:
    return f"""list_reduce(
    list_transform(string_split({a}, ''), lambda c: [unicode(c)::bigint]),
    lambda prev, c: list_reduce(
      list_transform(range(1, length({b}) + 1), lambda j: [j]),
      lambda cur, j: list_append(cur, CASE WHEN unicode({b}[j[1]]) = c[1]
        THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[j[1]]) END),
      [0::bigint]),
    list_transform(range(0, length({b}) + 1), lambda j: 0::bigint))[length({b}) + 1]"""


def _ratio_pairs(left: str, right: str, a: str, b: str, bound: float) -> str:
    """Pairs of left.a and right.b with an edit ratio above bound."""
    slack = round(1 - bound / 100, 6)
    total = f"(length({a}) + length({b}))"
    return f"""
  SELECT * FROM (
    WITH close AS MATERIALIZED (
      SELECT {a}, {b} FROM {left}, {right}
      WHERE CASE WHEN length({a}) = length({b}) AND {slack}::double * {total} < 2 THEN {a} = {b}
        ELSE abs(length({a}) - length({b})) <= {slack}::double * {total} + 1e-6
          AND levenshtein({a}, {b}) <= {slack}::double * {total} + 1e-6 END)
    SELECT {a}, {b}, 200.0::double * {_lcs(a, b)} / {total} AS ratio FROM close)
  WHERE ratio > {bound}"""


def _near_length(a: str, b: str) -> str:
    long, short = (
        f"greatest(length({a}), length({b}))",
        f"least(length({a}), length({b}))",
    )
    return f"{long} * 2 < {short} * 3"


def _name_scores(left: str, right: str, a: str, b: str, bound: float) -> str:
    return f"""
  SELECT {a}, {b}, round_even(ratio, 0)::double AS score FROM ({_ratio_pairs(left, right, a, b, bound)})
  UNION ALL
  SELECT {a}, {b}, 95.0::double
  FROM (SELECT {a}, list_distinct(string_split({a}, ' ')) AS aw, unnest(aw) AS word FROM {left})
  JOIN (SELECT {b}, list_distinct(string_split({b}, ' ')) AS bw, unnest(bw) AS word FROM {right})
    USING (word)
  GROUP BY {a}, {b}
  HAVING count(*) >= least(any_value(len(aw)), any_value(len(bw))) AND {_near_length(a, b)}
  UNION ALL
  SELECT {a}, {b}, round_even(0.95::double * s, 0)::double FROM ({_word_set_pairs(left, right, a, b)})
  WHERE s > {bound}::double / 0.95::double"""


def _word_set_pairs(left: str, right: str, a: str, b: str) -> str:
    """(a, b, s) of names that share some but not all words: the best ratio of their word sets."""
    return f"""
    SELECT {a}, {b}, greatest(
      CASE WHEN levenshtein(x, y) <= 0.1::double * whole
        THEN 100 - 100.0::double * (length(x) + length(y) - 2 * {_lcs("x", "y")}) / whole ELSE 0 END,
      100 - 100.0::double * (1 + length(x)) / (2 * n + 1 + length(x)),
      100 - 100.0::double * (1 + length(y)) / (2 * n + 1 + length(y))) AS s
    FROM (
      SELECT {a}, {b}, length(array_to_string(held, ' ')) AS n,
        array_to_string(list_sort(list_filter(aw, lambda w: NOT list_contains(held, w))), ' ') AS x,
        array_to_string(list_sort(list_filter(bw, lambda w: NOT list_contains(held, w))), ' ') AS y,
        2 * n + 2 + length(x) + length(y) AS whole
      FROM (
        SELECT {a}, {b}, any_value(aw) AS aw, any_value(bw) AS bw, list(word) AS held
        FROM (SELECT {a}, list_distinct(string_split({a}, ' ')) AS aw, unnest(aw) AS word FROM {left})
        JOIN (SELECT {b}, list_distinct(string_split({b}, ' ')) AS bw, unnest(bw) AS word FROM {right})
          USING (word)
        GROUP BY {a}, {b}
        HAVING count(*) < least(any_value(len(aw)), any_value(len(bw))) AND {_near_length(a, b)}))"""


PARTS = f"""
spelt AS (
  SELECT p_partkey, CASE p_type
    WHEN 'ECONOMY' THEN p_name || ' Inc.'
    WHEN 'SMALL' THEN upper(p_name) || ', Holdings'
    WHEN 'PROMO' THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
    WHEN 'LARGE' THEN left(p_name, length(p_name) - 1)
    WHEN 'MEDIUM' THEN p_brand || '/' || p_size
    ELSE 'p' || p_partkey END AS name
  FROM part),
part_dim AS (
  SELECT p_name AS company, 'P' || min(p_partkey) AS ticker FROM part GROUP BY p_name),
listed AS (
  SELECT {_clean("company")} AS clean, max(company) AS company, arg_max(ticker, company) AS ticker
  FROM part_dim GROUP BY 1),
guesses AS (
  SELECT replace(lower(p_brand), '#', ' ') || ' ' || p_size AS common, min(name) AS official
  FROM part JOIN spelt USING (p_partkey) GROUP BY 1),
known AS (
  SELECT common, official, {_clean("official")} AS guess,
    (SELECT max(company) FROM part_dim WHERE part_dim.company = official) AS same,
    (SELECT max(company) FROM listed WHERE clean = {_clean("official")}) AS by_clean
  FROM guesses),
open_guess AS (
  SELECT DISTINCT guess FROM known WHERE same IS NULL AND by_clean IS NULL AND guess <> ''),
sorted_left AS (
  SELECT guess, list_aggregate(list_sort(string_split(guess, ' ')), 'string_agg', ' ') AS ls
  FROM open_guess),
sorted_right AS (
  SELECT clean, list_aggregate(list_sort(string_split(clean, ' ')), 'string_agg', ' ') AS rs
  FROM listed),
sorted_ratio AS ({_ratio_pairs("(SELECT DISTINCT ls FROM sorted_left)", "(SELECT DISTINCT rs FROM sorted_right)", "ls", "rs", 89.5 / 0.95)}),
guess_score AS ({_name_scores("open_guess", "listed", "guess", "clean", 89.5)}
  UNION ALL
  SELECT guess, clean, round_even(ratio * 0.95::double, 0)::double
  FROM sorted_ratio JOIN sorted_left USING (ls) JOIN sorted_right USING (rs)
  WHERE {_near_length("guess", "clean")}
  UNION ALL
  SELECT guess, clean, 90.0::double FROM open_guess, listed
  WHERE (contains(guess, clean) OR contains(clean, guess))
    AND NOT {_near_length("guess", "clean")}
    AND greatest(length(guess), length(clean)) <= 8 * least(length(guess), length(clean))),
guess_best AS (
  SELECT guess, first(clean ORDER BY score DESC, clean) AS clean FROM guess_score GROUP BY guess),
alias AS (
  SELECT common, coalesce(same, by_clean, l.company) AS company
  FROM known LEFT JOIN guess_best USING (guess) LEFT JOIN listed l USING (clean)
  WHERE coalesce(same, by_clean, l.company) IS NOT NULL)"""


def _resolve(names: str, dim: str, listed: str, alias: str, shown: str = "ticker") -> str:
    """resolved(name, company) of the distinct names of a relation."""
    return f"""
wanted AS (
  SELECT DISTINCT name, upper(name) AS up, {_clean("name")} AS cleaned FROM {names}
  WHERE name IS NOT NULL),
direct AS (
  SELECT name, cleaned, coalesce(
    (SELECT max(ticker) FROM {dim} WHERE ticker = up),
    (SELECT min(d.ticker) FROM {alias} a JOIN {dim} d ON d.company = a.company
     WHERE a.common = cleaned)) AS direct
  FROM wanted),
still_open AS (SELECT DISTINCT cleaned FROM direct WHERE direct IS NULL AND cleaned <> ''),
name_score AS ({_name_scores("still_open", listed, "cleaned", "clean", 94.5)}),
name_best AS (
  SELECT cleaned, first(clean ORDER BY score DESC, clean) AS clean FROM name_score GROUP BY cleaned),
resolved AS (
  SELECT name, coalesce(direct, l.{shown}, '') AS company
  FROM direct LEFT JOIN name_best USING (cleaned) LEFT JOIN {listed} l USING (clean))"""


DIM = """
dim AS (
  SELECT c_name AS company, 'C' || c_custkey AS ticker, c_mktsegment AS sector,
    n_name AS sub_industry
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
nation_alias AS (SELECT lower(sub_industry) AS common, min(company) AS company FROM dim GROUP BY 1)"""

QUESTIONS = """
q AS (
  SELECT c_custkey AS question_id, CASE c_mktsegment
    WHEN 'BUILDING' THEN 'Show me the growth prediction for the market'
    WHEN 'MACHINERY' THEN 'What about ' || c_name || ' and others?'
    ELSE 'What about ' || c_name || ' and C' || (c_custkey + 1) || ' tomorrow?' END AS question
  FROM customer)"""

GAZETTEER = QUESTIONS + """,
known_names AS (SELECT DISTINCT company FROM ev WHERE company IS NOT NULL),
gaz AS (
  SELECT question_id, company FROM q, known_names
  WHERE contains(lower(question), lower(company))
    AND regexp_matches(lower(question), '\\b' || regexp_escape(lower(company)) || '\\b'))"""

TERMS = f"""
terms AS (
  SELECT question_id, unnest(list_distinct(list_filter(
    regexp_split_to_array(question, '(?i)[\\s,]+(?:and|or)?[\\s,]*'),
    lambda t: t <> '' AND lower(t) NOT IN ({_texts(QUESTION_FILLERS)})))) AS term
  FROM q)"""

DIM_LISTED = f"""
dim_listed AS (
  SELECT {_clean("company")} AS clean, max(company) AS company, arg_max(ticker, company) AS ticker
  FROM dim GROUP BY 1)"""

ASKED = ",".join(
    [
        GAZETTEER,
        TERMS,
        DIM,
        DIM_LISTED,
        """
silent AS (
  SELECT question_id, term AS name FROM terms
  WHERE question_id NOT IN (SELECT question_id FROM gaz))""",
        _resolve("silent", "dim", "dim_listed", "nation_alias"),
        """
asked_for AS (
  SELECT question_id, company FROM gaz
  UNION
  SELECT question_id, company FROM silent JOIN resolved USING (name) WHERE company <> '')""",
    ]
)

SELECTION = ASKED + """,
places AS (
  SELECT q.question_id, g.company, g.growth_score, a.company IS NOT NULL AS queried,
    (SELECT count(*) FROM asked_for x WHERE x.question_id = q.question_id) AS n_asked,
    count(a.company) OVER (PARTITION BY q.question_id) AS n_found,
    row_number() OVER (PARTITION BY q.question_id
      ORDER BY a.company IS NULL, g.growth_score DESC, g.company) AS position
  FROM q CROSS JOIN growth g
  LEFT JOIN (SELECT DISTINCT question_id, upper(company) AS company FROM asked_for) a
    ON a.question_id = q.question_id AND a.company = upper(g.company)),
chosen AS (
  SELECT question_id, position::integer AS position, company, growth_score, queried
  FROM places
  WHERE (n_asked = 0 OR n_found > 0) AND position <= greatest(25, n_found))"""

DETAILS = "," .join([BARS, QUOTES]) + """,
labels_of AS (
  SELECT company, count(*) FILTER (sentiment = 'negative') AS negative,
    count(*) FILTER (sentiment = 'neutral') AS neutral,
    count(*) FILTER (sentiment = 'positive') AS positive
  FROM ev WHERE company IS NOT NULL GROUP BY company),
tick AS (
  SELECT k, min(ticker) AS ticker FROM (
    SELECT company AS k, ticker FROM dim UNION ALL SELECT ticker, ticker FROM dim) GROUP BY k),
details AS (
  SELECT g.*, negative, neutral, positive, macro_sentiment_score, t.ticker,
    current_price, sma_20, sma_50, previous_close, day_high, day_low, volume, headlines
  FROM growth g LEFT JOIN labels_of l USING (company)
  LEFT JOIN customer ON g.company = 'C' || c_custkey
  LEFT JOIN (SELECT c_mktsegment AS theme, avg(normalized_sentiment) AS macro_sentiment_score
    FROM cs JOIN customer ON company = 'C' || c_custkey GROUP BY 1) ON theme = c_mktsegment
  LEFT JOIN tick t ON t.k = g.company LEFT JOIN quotes qu ON qu.ticker = t.ticker
  LEFT JOIN heads h ON h.company_key = upper(g.company))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _rounded(columns: str, digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _two(value: str) -> str:
    return f"coalesce(printf('%.2f', {value}), 'N/A')"


GROWTH_COLUMNS = (
    "company, ml_prediction, total_mentions, "
    + _rounded("sentiment_score time_decayed_sentiment growth_score market_sentiment")
)
FUSED_COLUMNS = "company, article_count, ml_prediction, ml_prediction_score, " + _rounded(
    "weighted_sentiment_sum normalized_sentiment final_score"
)

ORACLE: dict[str, str] = {
    "scan_lenient": _with(RAW_EVENTS) + """
SELECT company, sentiment, confidence AS sentiment_score, "timestamp" FROM raw_ev""",
    "scan_files": _with(RAW_EVENTS) + """
SELECT company, sentiment, confidence AS sentiment_score, "timestamp" FROM raw_ev WHERE sentiment <> 'negative'""",
    "scan_files_rejected": """
SELECT 5 AS fields, count(*) AS lines,
  max('C' || user_id || ';negative;' || (value / 1000)::varchar || ';' || ts::varchar || ';' || event_type || ' ' || props)
    AS last_line
FROM events WHERE event_type = 'error'""",
    "company_list": f"""
SELECT s_name AS company, 'C' || s_suppkey AS symbol FROM supplier
UNION ALL SELECT trim(replace(c, 'Inc.', '')), s FROM (VALUES {', '.join(f"('{c}', '{x}')" for c, x in FALLBACK_COMPANIES)}) t(c, s)""",
    "optional_source": _with(PREDICTIONS) + "SELECT * FROM pred",
    "flatten_json": _with(NEWS) + """,
lines AS (SELECT *, string_split(body, chr(10)) AS parts FROM news)
SELECT published AS "timestamp", 'news' AS source, headline, parts[i] AS text,
  url || '#' || (i - 1) AS url, source AS company
FROM lines, unnest(range(1, len(parts) + 1)) u(i)""",
    "cap_per_source": _with(NEWS) + """
SELECT role AS subreddit, conv_id, turn, created_utc, headline AS title FROM post
QUALIFY row_number() OVER (PARTITION BY role ORDER BY created_utc DESC, conv_id, turn) <= 50""",
    "post_rows": _with(NEWS) + """
SELECT make_timestamp((created_utc * 1000000)::bigint) AS "timestamp", 'reddit' AS source,
  headline, text, url, NULL::varchar AS company FROM post""",
    "price_range_scan": _with(
        _bars("WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1998-01-01'")
    )
    + "SELECT * FROM bars",
    "news_listing": """
SELECT coalesce(nullif(split_part(text, chr(10), 1), ''), 'No Title') AS title, source,
  lang AS date,
  'N/A' AS company_name, text AS snippet, 'doc:' || doc_id AS url
FROM documents""",
    "merge_sources": _with(MERGED) + "SELECT * FROM merged",
    "merge_sources_tolerant": _with(MERGED) + """
SELECT "timestamp", headline, text, source, CASE WHEN source = 'news' THEN url END AS url
FROM merged""",
    "attach_sentiment": _with(MERGED) + """,
scored AS (
  SELECT published AS "timestamp", headline, body AS text, source AS company,
    CASE WHEN toxic = 1 THEN -1 ELSE quality END AS sign
  FROM news JOIN labels USING (doc_id))
SELECT m."timestamp", m.headline, m.source, m.url, s.company,
  CASE WHEN sign > 0 THEN 'positive' WHEN sign < 0 THEN 'negative'
       WHEN sign = 0 THEN 'neutral' END AS sentiment, sign::double AS sentiment_score
FROM merged m LEFT JOIN scored s
  ON m."timestamp" IS NOT DISTINCT FROM s."timestamp" AND m.headline = s.headline AND m.text = s.text""",
    "normalize_filter": _with(RAW_EVENTS) + """
SELECT event_id, company, sentiment FROM raw_ev WHERE company IS NOT NULL AND company <> ''""",
    "latest_headlines": _with(TEXTS) + """
SELECT event_id, "timestamp", headline FROM tm
ORDER BY "timestamp" DESC NULLS LAST, event_id LIMIT 5""",
    "top_headlines_per_company": _with(HEADLINES) + "SELECT * FROM heads",
    "decay_weight": _with(EVENTS) + """
SELECT event_id, round(time_decay_weight, 9) AS by_seconds, round(slow_weight, 9) AS by_hours
FROM weighted""",
    "weighted_mentions": _with(EVENTS) + f"""
SELECT event_id, {_rounded("sentiment_score time_decay_weight weighted_sentiment")} FROM weighted""",
    "company_sentiment": _with(SENTIMENT) + f"""
SELECT company, article_count, {_rounded("weighted_sentiment_sum normalized_sentiment")} FROM cs""",
    "company_mentions": _with(EVENTS) + """
SELECT company, count(*) AS mention_count FROM ev WHERE company IS NOT NULL GROUP BY company""",
    "decayed_mean": _with(SENTIMENT)
    + "SELECT company, round(time_decayed_sentiment, 9) AS time_decayed_sentiment, total_mentions FROM dm",
    "label_pivot": _with(EVENTS) + """
SELECT company, count(*) FILTER (sentiment = 'negative') AS negative,
  count(*) FILTER (sentiment = 'neutral') AS neutral,
  count(*) FILTER (sentiment = 'positive') AS positive
FROM ev WHERE company IS NOT NULL GROUP BY company""",
    "sector_sentiment": _with(SENTIMENT) + """
SELECT c_mktsegment AS sector, round(avg(normalized_sentiment), 9) AS normalized_sentiment
FROM cs JOIN customer ON company = 'C' || c_custkey GROUP BY 1""",
    "label_map7": """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5
  WHEN 'error' THEN -1.0 ELSE 0.0 END::double AS sentiment_score FROM events""",
    "lexicon_weights": _with(LEXICON) + "SELECT * FROM lexicon",
    "lexicon_score": _with(LEXICON, _lexicon("text", "documents"))
    + "SELECT doc_id, s AS lexicon_score FROM lexicon_scored",
    "sentiment_lexicon": _with(NEWS, LEXICON, _lexicon("headline || ' ' || body", "news")) + """
SELECT doc_id, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END
  AS sentiment, round(abs(s) / (1 + abs(s)), 9) AS confidence FROM lexicon_scored""",
    "held_out_labels": """
SELECT CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
  count(*) AS documents FROM labels JOIN documents USING (doc_id)
WHERE ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 5 = 0 GROUP BY 1""",
    "market_series": _with(EVENTS) + """
SELECT "timestamp"::date AS date, round(avg(sentiment_score), 9) AS sentiment_score
FROM weighted WHERE "timestamp" IS NOT NULL GROUP BY 1""",
    "score_summary": _with(EVENTS) + """
SELECT count(sentiment_score) AS "count", round(avg(sentiment_score), 9) AS mean,
  round(stddev_samp(sentiment_score), 9) AS std, round(min(sentiment_score), 9) AS min,
  round(quantile_cont(sentiment_score, 0.25), 9) AS q25,
  round(quantile_cont(sentiment_score, 0.5), 9) AS q50,
  round(quantile_cont(sentiment_score, 0.75), 9) AS q75, round(max(sentiment_score), 9) AS max
FROM weighted""",
    "label_value_counts": _with(EVENTS) + """
SELECT sentiment, count(*) AS "count" FROM ev GROUP BY sentiment
ORDER BY "count" DESC, sentiment LIMIT 10""",
    "top_keywords": _with(TEXTS, _top_words("tm", "text")) + "SELECT * FROM top_words",
    "cms_keywords": _with(
        TEXTS,
        _top_words("tm", "text"),
        f"""
feed AS (
  SELECT keyword FROM (
    SELECT unnest({_word_tokens("text || ' ' || source")}) AS keyword FROM tm)
  WHERE keyword IN (SELECT keyword FROM top_words))""",
        _sketch("feed", 500, 5),
    )
    + "SELECT * FROM estimates",
    "cms_wide": _with(
        _top_words("documents", "text"),
        f"""
feed AS (
  SELECT keyword FROM words WHERE length(keyword) > 3 AND keyword NOT IN ({_STOPS}))""",
        _sketch("feed", 1000, 10),
    )
    + "SELECT * FROM estimates",
    "edw_keywords": _with(
        TEXTS,
        _top_words("tm", "text"),
        f"""
pieces AS (
  SELECT unnest({_space_tokens("text || ' ' || source")}) AS keyword,
    coalesce(exp(-1e-5::double * age_s), 0) AS weight FROM tm)""",
    )
    + """
SELECT keyword, round(sum(weight), 9) AS weight FROM pieces
WHERE keyword IN (SELECT keyword FROM top_words)
GROUP BY keyword ORDER BY sum(weight) DESC, keyword LIMIT 15""",
    "theme_sentiment": _with(
        TEXTS,
        _themes(),
        f"pieces AS (SELECT unnest({_space_tokens('text')}) AS keyword, sentiment FROM tm)",
    )
    + """
SELECT theme, count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'neutral') AS neutral,
  count(*) FILTER (sentiment = 'negative') AS negative,
  round((positive - negative) / (positive + neutral + negative)::double, 3) AS macro_sentiment_score
FROM pieces JOIN themes USING (keyword) GROUP BY theme""",
    "growth_score": _with(GROWTH) + f"SELECT {GROWTH_COLUMNS} FROM growth",
    "growth_from_tables": _with(GROWTH) + f"SELECT {GROWTH_COLUMNS} FROM growth",
    "top_growth": _with(GROWTH)
    + f"SELECT {GROWTH_COLUMNS} FROM growth ORDER BY growth.growth_score DESC, company LIMIT 5",
    "top_bottom": _with(GROWTH) + """
SELECT * FROM (SELECT 'top' AS side, company, round(growth_score, 9) AS growth_score FROM growth
  ORDER BY growth.growth_score DESC, company LIMIT 2)
UNION ALL
SELECT * FROM (SELECT 'bottom' AS side, company, round(growth_score, 9) AS growth_score FROM growth
  ORDER BY growth.growth_score, company DESC LIMIT 2)""",
    "fuse_scores": _with(FUSED) + f"SELECT {FUSED_COLUMNS} FROM fused",
    "top3_fused": _with(FUSED)
    + f"SELECT {FUSED_COLUMNS} FROM fused ORDER BY fused.final_score DESC, company LIMIT 3",
    "fused_lines": _with(FUSED) + f"""
SELECT company, chr(10) || 'Company: ' || company
  || chr(10) || 'Sentiment Score: ' || {_two("normalized_sentiment")}
  || chr(10) || 'ML Prediction: ' || coalesce(ml_prediction, 'nan')
  || chr(10) || 'Final Score: ' || {_two("final_score")} AS line
FROM fused""",
    "growth_score_100": _with(EVENTS, MOOD) + """
SELECT company, round(50 + 50 * avg(sentiment_score * exp(-1e-5::double * age_s)
    * (1 + (SELECT market_sentiment FROM mood))), 9) AS growth_score,
  round(avg(sentiment_score * exp(-1e-5::double * age_s)
    * (1 + (SELECT market_sentiment FROM mood))), 9) AS avg_sentiment,
  count(*) AS sentiment_count,
  strftime(make_timestamp(max(now_us)), '%Y-%m-%d %H:%M:%S') || ' UTC' AS last_updated
FROM weighted WHERE company IS NOT NULL GROUP BY company""",
    "market_label": _with(GROWTH) + """
SELECT round(max(market_sentiment), 9) AS market_sentiment,
  CASE WHEN max(market_sentiment) > 0.1 THEN 'Positive'
       WHEN max(market_sentiment) < -0.1 THEN 'Negative' ELSE 'Neutral' END AS label
FROM growth""",
    "mention_labels": _with(EVENTS) + """
SELECT event_id, CASE WHEN sentiment_score > 0.1::double THEN 'Positive'
  WHEN sentiment_score < -0.1::double THEN 'Negative' ELSE 'Neutral' END AS label FROM weighted""",
    "update_join": _with(PREDICTIONS) + """
SELECT 'C' || c_custkey AS company, c_mktsegment AS sector,
  coalesce(nullif(ml_prediction, 'neutral'), 'none yet') AS ml_prediction
FROM customer LEFT JOIN pred ON company = 'C' || c_custkey""",
    "known_companies": _with(EVENTS, PREDICTIONS) + """
SELECT company FROM ev WHERE company IS NOT NULL UNION SELECT company FROM pred""",
    "companies_intersect": _with(EVENTS, PREDICTIONS) + """
SELECT company FROM ev WHERE company IS NOT NULL INTERSECT SELECT company FROM pred""",
    "companies_except": _with(EVENTS, PREDICTIONS) + """,
have AS (SELECT DISTINCT company FROM ev WHERE company IS NOT NULL)
SELECT 'first only' AS side, company FROM have WHERE company NOT IN (SELECT company FROM pred)
UNION ALL
SELECT 'second only', company FROM pred WHERE company NOT IN (SELECT company FROM have)""",
    "price_features": _with(FEATURE_ROWS) + f"""
SELECT ticker, trade_date, target, {_rounded("price_change ma_5 ma_10", 4)} FROM features""",
    "scaled_features": _with(SCALED) + f"""
SELECT ticker, trade_date, target, {_rounded("ma_5 ma_10 sentiment")} FROM scaled""",
    "sequences": _with(SCALED) + f"""
SELECT ticker, trade_date, target, {_steps(1)} FROM scaled
WINDOW t AS (PARTITION BY ticker ORDER BY trade_date)
QUALIFY row_number() OVER t > {STEPS}""",
    "direction_split": _with(SCALED) + f"""
, samples AS (
  SELECT target, ('0x' || substr(md5(ticker || '|' || strftime(trade_date, '%Y-%m-%d')), 1, 8))::bigint % 10
    AS cell
  FROM (SELECT * FROM scaled QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date) > {STEPS})
  WHERE NOT is_last)
SELECT CASE WHEN cell < 8 THEN 'train' ELSE 'test' END AS part, count(*) AS samples,
  round(avg(target::double), 9) AS rising FROM samples GROUP BY 1""",
    "latest_sequences": _with(SCALED) + f"""
SELECT * EXCLUDE is_last FROM (
  SELECT ticker, trade_date, is_last, {_steps(0)} FROM scaled
  WINDOW t AS (PARTITION BY ticker ORDER BY trade_date)
  QUALIFY row_number() OVER t >= {STEPS}) WHERE is_last""",
    "sentiment_area": _with(EVENTS) + """
, told AS (SELECT least(greatest(confidence, 0), 1) AS s, sentiment = 'positive' AS up FROM ev),
ranked AS (SELECT up, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::double AS place FROM told)
SELECT count(*) FILTER (up) AS positives, count(*) FILTER (NOT up) AS negatives,
  round((sum(place) FILTER (up) - count(*) FILTER (up) * (count(*) FILTER (up) + 1) / 2.0::double)
    / (count(*) FILTER (up) * (count(*) FILTER (NOT up))::double), 9) AS area FROM ranked""",
    "prices_of_movers": _with(BARS, PREDICTIONS) + """
SELECT ticker, count(*) AS days, round(max(high), 4) AS high FROM bars
WHERE trade_date >= '1995-01-01' AND ticker IN (SELECT company FROM pred WHERE ml_prediction = 'up') GROUP BY ticker""",
    "market_returns": """
WITH closes AS (
  SELECT date_trunc('day', o_orderdate)::timestamp AS trade_date, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS close
  FROM orders GROUP BY 1)
SELECT trade_date, round(close, 6) AS close, round(close / lag(close) OVER w - 1, 6) AS change,
  round(close / first_value(close) OVER w - 1, 6) AS total_change FROM closes WINDOW w AS (ORDER BY trade_date)""",
    "signals_by_day": _with(SENTIMENT) + """
SELECT company, article_count, round(weighted_sentiment_sum, 9) AS weighted_sentiment_sum,
  round(normalized_sentiment, 9) AS normalized_sentiment,
  round(time_decayed_sentiment, 9) AS time_decayed_sentiment, total_mentions
FROM cs LEFT JOIN dm USING (company)""",
    "sma_latest": _with(BARS, QUOTES)
    + f"SELECT ticker, {_rounded('sma_20 sma_50', 4)} FROM quotes",
    "latest_quote": _with(BARS, QUOTES) + f"""
SELECT ticker, trade_date, volume,
  {_rounded("current_price previous_close day_high day_low sma_20 sma_50", 4)} FROM quotes""",
    "market_mood": _with(MOOD)
    + "SELECT round(market_sentiment, 9) AS market_sentiment FROM mood",
    "clean_name": _with(PARTS) + f"SELECT p_partkey, {_clean('name')} AS clean FROM spelt",
    "name_mapping": _with(PARTS)
    + f"SELECT DISTINCT name, {_clean('name')} AS normalized_company FROM spelt",
    "fuzzy_match": _with(
        PARTS,
        "low AS (SELECT DISTINCT name, lower(name) AS low FROM spelt)",
        "off AS (SELECT lower(company) AS listed_low, min(company) AS official FROM part_dim GROUP BY 1)",
        "rest AS (SELECT DISTINCT low FROM low WHERE low NOT IN (SELECT listed_low FROM off))",
        f"near AS ({_ratio_pairs('rest', 'off', 'low', 'listed_low', 80.5)})",
        """best AS (
  SELECT low, first(official ORDER BY round_even(ratio, 0) DESC, official) AS official
  FROM near JOIN off USING (listed_low) GROUP BY low)""",
    )
    + """
SELECT name, official, 'exact' AS kind FROM low JOIN off ON low.low = off.listed_low
UNION ALL
SELECT name, official, 'fuzzy' FROM low JOIN best USING (low)""",
    "alias_resolve": _with(PARTS) + "SELECT * FROM alias",
    "normalize_company": _with(PARTS, _resolve("spelt", "part_dim", "listed", "alias"))
    + "SELECT * FROM resolved",
    "normalize_mentions": _with(PARTS, _resolve("spelt", "part_dim", "listed", "alias", "company"))
    + "SELECT p_partkey, company FROM spelt JOIN resolved USING (name) WHERE company <> ''",
    "ticker_lookup": _with(DIM, PREDICTIONS) + """,
names AS (SELECT company AS name FROM dim UNION SELECT company FROM pred)
SELECT name, (SELECT min(ticker) FROM dim d WHERE d.company = name OR d.ticker = name) AS ticker
FROM names""",
    "company_lookup": _with(EVENTS, DIM) + """
SELECT DISTINCT lower(e.company) AS ticker, d.company
FROM ev e LEFT JOIN dim d ON d.ticker = upper(e.company) WHERE e.company IS NOT NULL""",
    "question_terms": _with(QUESTIONS, TERMS) + "SELECT * FROM terms",
    "nested_names": "WITH RECURSIVE " + """
asked AS (
  SELECT p_partkey, lower(CASE p_type
    WHEN 'ECONOMY' THEN 'Is ' || upper(p_name) || ' better than any ' || split_part(p_name, ' ', 2) || '?'
    WHEN 'SMALL' THEN split_part(p_name, ' ', 1) || ', ' || p_name || ' or ' || split_part(p_name, ' ', 2) || '?'
    WHEN 'LARGE' THEN split_part(p_name, ' ', 2) || 's and ' || replace(p_name, ' ', '-') || ' tomorrow'
    ELSE 'Show ' || p_name || ' for ' || lower(p_brand) END) AS question
  FROM part),
listed AS (SELECT p_name AS company FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part),
tried AS (
  SELECT p_partkey, lower(company) AS low, company, '\\b' || regexp_escape(lower(company)) || '\\b' AS pattern,
    row_number() OVER (PARTITION BY p_partkey ORDER BY length(company) DESC, company) AS i
  FROM asked, listed WHERE contains(question, lower(company))),
walk AS (
  SELECT p_partkey, 0::bigint AS i, question AS rest, NULL::varchar AS found FROM asked
  UNION ALL
  SELECT w.p_partkey, t.i, CASE WHEN regexp_matches(w.rest, t.pattern) THEN replace(w.rest, t.low, '') ELSE w.rest END,
    CASE WHEN regexp_matches(w.rest, t.pattern) THEN t.company END
  FROM walk w JOIN tried t ON t.p_partkey = w.p_partkey AND t.i = w.i + 1)
SELECT p_partkey, found AS company FROM walk WHERE found IS NOT NULL""",
    "gazetteer_match": _with(EVENTS, GAZETTEER) + "SELECT * FROM gaz",
    "companies_in_questions": _with(EVENTS, ASKED) + "SELECT * FROM asked_for",
    "extract_company": _with(DIM) + """,
heads AS (
  SELECT o_orderkey, CASE o_orderstatus
    WHEN 'F' THEN 'Big order for ' || ticker || ' lifts ' || company
    WHEN 'O' THEN upper(company) || ' ships ' || o_orderpriority
    ELSE upper(left(sub_industry, 1)) || lower(substr(sub_industry, 2)) || ': talks with '
      || lower(ticker) END AS headline, o_orderstatus, ticker, sub_industry
  FROM orders JOIN dim ON ticker = 'C' || o_custkey)
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN ticker ELSE (
    SELECT d.ticker FROM nation_alias a JOIN dim d USING (company)
    WHERE a.common = lower(heads.sub_industry)) END AS company
FROM heads""",
    "extract_resolved": _with(DIM) + """,
heads AS (
  SELECT o_orderkey, o_orderstatus, ticker, company, sub_industry
  FROM orders JOIN dim ON ticker = 'C' || o_custkey)
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ticker WHEN 'O' THEN company
    ELSE lower(sub_industry) END AS spelling,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN ticker ELSE (
    SELECT d.ticker FROM nation_alias a JOIN dim d USING (company)
    WHERE a.common = lower(heads.sub_industry)) END AS company
FROM heads""",
    "join_ci": _with(SENTIMENT, PREDICTIONS) + f"""
SELECT lower(pred.company) AS company, ml_prediction, article_count,
  {_rounded("weighted_sentiment_sum normalized_sentiment")}
FROM pred LEFT JOIN cs ON upper(cs.company) = upper(pred.company)""",
    "join_theme_optional": _with(SENTIMENT) + """,
sectors AS (
  SELECT c_mktsegment AS theme, round(avg(normalized_sentiment), 9) AS macro_sentiment_score
  FROM cs JOIN customer ON company = 'C' || c_custkey GROUP BY 1)
SELECT 'C' || c_custkey AS company, c_mktsegment AS theme, macro_sentiment_score
FROM customer LEFT JOIN sectors ON theme = c_mktsegment
UNION ALL
SELECT 'C' || c_custkey, NULL, NULL FROM customer""",
}

for _name, _chosen in (
    ("company_series", ""),
    ("company_series_chosen", "AND company IN ('C1', 'C3', 'C5', 'C7', 'none')"),
):
    ORACLE[_name] = _with(EVENTS) + f"""
SELECT company AS name,
  (row_number() OVER (PARTITION BY company ORDER BY day) - 1)::integer AS position,
  day AS date, score
FROM (SELECT company, "timestamp"::date AS day, round(avg(sentiment_score), 9) AS score
  FROM weighted WHERE "timestamp" IS NOT NULL AND company IS NOT NULL {_chosen} GROUP BY ALL)"""

for _name, _days in (("market_indicators", None), ("market_indicators_30_days", 30)):
    ORACLE[_name] = _with(_market(_days)) + """
SELECT round(arg_max(vix_close, trade_date), 4) AS vix_current, round(avg(vix_close), 4) AS vix_avg,
  round(stddev_pop(vix_close), 4) AS vix_std,
  round((arg_max(index_close, trade_date) / arg_min(index_close, trade_date) - 1) * 100, 4)
    AS index_return,
  round(stddev_pop(change) * sqrt(252), 4) AS index_volatility
FROM moves"""

ORACLE["context_select"] = _with(GROWTH, SELECTION) + """
SELECT question_id, position, company, round(growth_score, 9) AS growth_score, queried FROM chosen"""

_DETAIL_COLUMNS = """ml_prediction, total_mentions, negative, neutral, positive, ticker, volume,
  headlines, """ + _rounded(
    "sentiment_score time_decayed_sentiment market_sentiment macro_sentiment_score current_price "
    "sma_20 sma_50 previous_close day_high day_low",
    4,
)
_TEXT_GROWTH = GROWTH + HEADLINES[len(EVENTS) :]

ORACLE["company_context"] = _with(_TEXT_GROWTH, SELECTION, DETAILS) + f"""
SELECT question_id, position, company, round(c.growth_score, 4) AS growth_score, queried,
  {_DETAIL_COLUMNS}
FROM chosen c LEFT JOIN (SELECT * EXCLUDE growth_score FROM details) USING (company)"""

ORACLE["context_lines"] = _with(_TEXT_GROWTH, DIM, DETAILS) + f"""
SELECT company, '- ' || company || ':' || chr(10)
  || '  - ML Prediction for Tomorrow: ' || ml_prediction || chr(10)
  || '  - Time-Decayed Sentiment: ' || {_two("time_decayed_sentiment")} || chr(10)
  || '  - Overall Growth Score: ' || {_two("growth_score")} || chr(10)
  || '  - Base Sentiment Score: ' || {_two("sentiment_score")} || chr(10)
  || '  - Total News Mentions: ' || total_mentions || chr(10)
  || coalesce('  - Top Headlines: ' || headlines, '') AS line
FROM details"""
