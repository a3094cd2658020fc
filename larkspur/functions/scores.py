"""Scalar functions over scores and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as a double; `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def harmonic(a: Column, b: Column) -> Column:
    return ratio(2 * a * b, a + b)


def clamp_unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def finite(x: Column) -> Column:
    """x, or an error if it is null, NaN or infinite: such scores must not be ranked."""
    bad = x.isNull() | F.isnan(x - x)
    return F.when(bad, F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(x)


def aligned(score: Column, threshold: Column) -> Column:
    """Piecewise linear: 0 to 0, the threshold to 0.5, 1 to 1; a threshold at an edge leaves one line."""
    low = 0.5 * score / threshold
    high = 0.5 + 0.5 * (score - threshold) / (1 - threshold)
    return F.when(threshold <= 0, 0.5 + 0.5 * score).when(threshold >= 1, F.when(score >= threshold, F.lit(1.0)).otherwise(0.5 * score)).when(score < threshold, low).otherwise(high)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def fused(a: Column, b: Column, alpha: Column) -> Column:
    """The sigmoid of a weighted mean of two logits."""
    return sigmoid((1 - alpha) * logit(a) + alpha * logit(b))


def cosine_to_unit(c: Column) -> Column:
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) + 1) / 2


def entropy(p: Column) -> Column:
    """Shannon entropy (natural) of an array of shares."""
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def sorted_desc(x: Column) -> Column:
    return F.sort_array(x, asc=False)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def next_up(x: Column) -> Column:
    """The next double above x."""
    return F.call_function("java_method", F.lit("java.lang.Math"), F.lit("nextUp"), x).cast("double")
