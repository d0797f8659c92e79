"""Numeric guards and scalar scores as column expressions.

Missing numbers are SQL NULL everywhere. NaN and infinities are turned into NULL at the edges, because
Spark orders NaN above every number and lets it spread through averages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import StudyQuality


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or NULL when it is NaN, infinite or missing."""
    c = as_column(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def zero_if_missing(c: Column | str) -> Column:
    """The value, or 0 when it is NaN, infinite or missing (scoring input)."""
    return F.coalesce(finite(c), F.lit(0.0))


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(c)))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL."""
    c = as_column(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Share as a double, 0 when the denominator is 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def load_level(load: Column | str) -> Column:
    load = as_column(load)
    return F.when(load < 0.4, "low").when(load < 0.7, "medium").when(load.isNotNull(), "high")


def eye_state(ear: Column | str) -> Column:
    ear = as_column(ear)
    return (
        F.when(ear.isNull() | F.isnan(ear), "unknown")
        .when(ear < 0.21, "closed")
        .when(ear < 0.25, "partial")
        .otherwise("open")
    )


def low_valid_ratio(c: Column | str, quality: StudyQuality = StudyQuality()) -> Column:
    return as_column(c) < quality.min_valid_ratio


def unstable_illumination(c: Column | str, quality: StudyQuality = StudyQuality()) -> Column:
    return as_column(c) > quality.max_illumination_std


def effective_exposure(base: Column | str, pacing_offset: Column | str) -> Column:
    return as_column(base) + as_column(pacing_offset)
