"""Scores and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
HIT_LIMITS = (1, 100)


def clamp(value: Column, low, high) -> Column:
    """Limit to [low, high]; null and NaN pass through (``least``/``greatest`` would lose them)."""
    return F.when(value.isNull() | F.isnan(value), value).otherwise(
        F.least(F.greatest(value, F.lit(low)), F.lit(high))
    )


def clamp_limit(limit: Column) -> Column:
    low, high = HIT_LIMITS
    return F.when(limit.isNotNull(), F.least(F.greatest(limit, F.lit(low)), F.lit(high)))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b) in [0, 2]; NaN when either vector is zero."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    similarity = F.try_divide(_dot(a, b), norms)
    return F.when(similarity.isNull(), F.lit(float("nan"))).otherwise(
        F.lit(1.0) - clamp(similarity, -1.0, 1.0)
    )


def cosine_score(distance: Column) -> Column:
    """Distance clamped to [0, 2] and mapped onto [1, 0]."""
    return (F.lit(2.0) - clamp(distance, 0.0, 2.0)) / 2.0


def similarity_percent(distance: Column) -> Column:
    return F.when(distance.isNull() | F.isnan(distance), F.lit(0.0)).otherwise(
        clamp(cosine_score(distance) * 100.0, 0.0, 100.0)
    )


def score_percent(total: Column) -> Column:
    """A fused score shown as a percentage; NaN shows as 0."""
    return F.when(total.isNull() | F.isnan(total), F.lit(0.0)).otherwise(clamp(total, 0.0, 1.0) * 100.0)


def semantic_score(distance: Column, weight: Column) -> Column:
    return weight * (F.lit(1.0) - distance / 2.0)


def reciprocal_rank_score(position: Column, weight: Column, k: int = RRF_K) -> Column:
    """(k+1)/(k+position) scaled by weight, so the first hit scores exactly ``weight``."""
    return F.lit(1.0) / (F.lit(float(k)) + position) * F.lit(float(k + 1)) * weight


def rank_value_score(rank: Column, weight: Column) -> Column:
    """Text-only search feeds the rank *value* into the reciprocal, with constants 60 and 61."""
    return weight * (F.lit(1.0) / (F.lit(60.0) + F.greatest(rank, F.lit(0.0)))) * 61.0
