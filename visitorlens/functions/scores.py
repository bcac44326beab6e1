"""Scalar score rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitorlens.functions.expr import let

# Sentiment thresholds, both ends inclusive.
NEGATIVE_AT = -0.05
POSITIVE_AT = 0.05


def label_sentiment(compound: Column) -> Column:
    """Label of a compound score; a null score (no text) is Neutral."""
    return (
        F.when(compound <= NEGATIVE_AT, F.lit("Negative"))
        .when(compound >= POSITIVE_AT, F.lit("Positive"))
        .otherwise(F.lit("Neutral"))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x
    )


def unit_vector(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero, so that its cosine is 0."""

    def scaled(norm: Column) -> Column:
        return F.transform(
            v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0))
        )

    return let(F.sqrt(dot(v, v)), scaled)
