"""Numeric expressions: clamps, coercions, entropies, argmax over probabilities, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def as_number(c: Column) -> Column:
    """Null for what is no number, NaN included."""
    x = c.try_cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def score_0_to_5(c: Column) -> Column:
    """Nearest integer (half to even) within 0 and 5; 0 for what is no number."""
    return F.coalesce(clip(F.bround(as_number(c)), 0.0, 5.0), F.lit(0.0)).cast("int")


def percent(c: Column) -> Column:
    return F.bround(100 * as_number(c), 1)


def confidence(p: Column, epsilon: float = 1e-12) -> Column:
    return F.array_max(F.transform(p, lambda x: x + epsilon))


def certainty(p: Column, epsilon: float = 1e-12) -> Column:
    """1 less the entropy over the log of the number of classes: 0 if all are alike, 1 if one is sure."""
    entropy = -F.aggregate(F.transform(p, lambda x: (x + epsilon) * F.ln(x + epsilon)), F.lit(0.0), lambda a, b: a + b)
    return 1 - entropy / F.ln(F.size(p))


def first_of_largest(p: Column, names: Column) -> Column:
    """The name at the largest value; of equals the first."""
    return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def min_max_scaled(c: Column, *, lower_is_better: bool = False, over: Column | None = None) -> Column:
    """Scaled to 0..1 over all rows (or those with the same over). All ones if at most one value is not null; ones if all are equal."""
    w = Window.partitionBy(F.lit(1) if over is None else over)
    low, high = F.min(c).over(w), F.max(c).over(w)
    x = F.when(c.isNull(), None).when(high == low, F.lit(1.0)).otherwise((c - low) / (high - low))
    return F.when(F.count(c).over(w) <= 1, F.lit(1.0)).otherwise(1 - x if lower_is_better else x)


def two_sided_normal(z: Column, terms: int = 60) -> Column:
    """p value of a z score, by the complementary error function: a series below 3, a continued fraction above. Null for null."""
    x = F.abs(z) / math.sqrt(2)
    steps = F.sequence(F.lit(terms), F.lit(1), F.lit(-1))
    inner = F.aggregate(steps, F.lit(1.0), lambda acc, k: 1 + acc * 2 * x * x / (2 * k + 1))
    outer = F.aggregate(steps, F.lit(0.0), lambda acc, k: (k / F.lit(2.0)) / (x + acc))
    return F.when(x < 3, 1 - 2 / math.sqrt(math.pi) * x * F.exp(-x * x) * inner).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / (x + outer))
