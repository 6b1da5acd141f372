"""Label to number and number to label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Graded sentiment labels and their scores.
LABEL_SCORES = {
    "positive": 1.0,
    "neutral": 0.0,
    "negative": -1.0,
    "very_positive": 1.0,
    "very_negative": -1.0,
    "slightly_positive": 0.5,
    "slightly_negative": -0.5,
}


def label_sign(sentiment: Column) -> Column:
    return (
        F.when(sentiment == "positive", F.lit(1))
        .when(sentiment == "negative", F.lit(-1))
        .otherwise(F.lit(0))
    )


def signed_confidence(sentiment: Column, confidence: Column | None = None) -> Column:
    confidence = F.lit(1.0) if confidence is None else confidence
    return label_sign(sentiment) * confidence


def graded_label_score(sentiment: Column) -> Column:
    """Score of a label in any letter case, 0 when unknown or missing."""
    scores = F.create_map(*[F.lit(x) for pair in LABEL_SCORES.items() for x in pair])
    return F.coalesce(F.try_element_at(scores, F.lower(sentiment)), F.lit(0.0))


def direction_score(prediction: Column) -> Column:
    """up 1, down -1, anything else 0."""
    return (
        F.when(prediction == "up", F.lit(1))
        .when(prediction == "down", F.lit(-1))
        .otherwise(F.lit(0))
    )


def up_or_down_score(prediction: Column) -> Column:
    """up 1, anything else (missing too) -1."""
    return F.when(prediction == "up", F.lit(1)).otherwise(F.lit(-1))


def market_label(value: Column) -> Column:
    return (
        F.when(value > 0.1, F.lit("Positive"))
        .when(value < -0.1, F.lit("Negative"))
        .otherwise(F.lit("Neutral"))
    )
