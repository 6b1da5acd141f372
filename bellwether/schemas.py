"""Table schemas and the column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_STRING, _DOUBLE, _LONG = T.StringType(), T.DoubleType(), T.LongType()


def _schema(columns: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _strings(*names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names, _STRING)


ARTICLE = _schema(
    {
        **_strings("publishedAt", "title", "description", "url"),
        "source": _schema(_strings("id", "name")),
    }
)
NEWS_LANDED = _schema({"articles": T.ArrayType(ARTICLE), "keyword": _STRING})
POSTS_LANDED = _schema(
    {"title": _STRING, "text": _STRING, "created_utc": _DOUBLE, **_strings("url", "subreddit")}
)
MENTIONS = _schema(
    {"timestamp": T.TimestampType(), **_strings("headline", "text", "source", "url", "company")}
)
SCORED_MENTIONS = T.StructType(
    MENTIONS.fields
    + _schema(
        {
            "sentiment": _STRING,
            "confidence": _DOUBLE,
            "sentiment_score": _DOUBLE,
            "time_decay_weight": _DOUBLE,
            "weighted_sentiment": _DOUBLE,
        }
    ).fields
)
COMPANY_SENTIMENT = _schema(
    {
        "company": _STRING,
        "weighted_sentiment_sum": _DOUBLE,
        "article_count": _LONG,
        "normalized_sentiment": _DOUBLE,
    }
)
LABEL_COUNTS = _schema(
    {"company": _STRING, "negative": _LONG, "neutral": _LONG, "positive": _LONG}
)
COMPANY_MENTIONS = _schema({"company": _STRING, "mention_count": _LONG})
PREDICTIONS = _schema(_strings("company", "ml_prediction"))
GROWTH = _schema(
    {
        "company": _STRING,
        "sentiment_score": _DOUBLE,
        "time_decayed_sentiment": _DOUBLE,
        "ml_prediction": _STRING,
        "growth_score": _DOUBLE,
        "market_sentiment": _DOUBLE,
        "total_mentions": _LONG,
    }
)
LEXICON = _schema({"keyword": _STRING, "weight": _DOUBLE})
COMPANY_DIM = _schema(_strings("company", "ticker", "sector", "sub_industry"))
MACRO_SENTIMENT = _schema(
    {
        "theme": _STRING,
        "positive": _LONG,
        "neutral": _LONG,
        "negative": _LONG,
        "macro_sentiment_score": _DOUBLE,
    }
)
PRICES = _schema(
    {
        "ticker": _STRING,
        "trade_date": T.TimestampType(),
        "open": _DOUBLE,
        "high": _DOUBLE,
        "low": _DOUBLE,
        "close": _DOUBLE,
        "volume": _LONG,
    }
)
NEWS_LISTING = _schema(
    _strings("title", "snippet", "source", "date", "formatted_date", "company_name", "url")
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return df unchanged, or raise ValueError naming the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
