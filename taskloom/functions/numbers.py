"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def ratio(num: Column, den: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.when(den != 0, num.cast("double") / den)


def ratio0(num: Column, den: Column) -> Column:
    """0.0 where the denominator is 0 or null."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def mean0(value: Column) -> Column:
    """Mean, 0.0 for no rows."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def percent(num: Column, den: Column) -> Column:
    return ratio0(num * 100.0, den)


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """T5: (proportion, lower, upper), clamped to [0, 1], zeros when n = 0."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n
    den = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / den
    some = total > 0
    return (
        F.when(some, p).otherwise(0.0),
        F.when(some, F.greatest(F.lit(0.0), centre - spread)).otherwise(0.0),
        F.when(some, F.least(F.lit(1.0), centre + spread)).otherwise(0.0),
    )


def cohens_h(p1: Column, p2: Column) -> Column:
    """T6."""
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def cohens_d(n1, mean1, var1, n2, mean2, var2) -> Column:
    """T7 from sufficient statistics; null for n < 2, 0 for no spread."""
    pooled = F.sqrt(F.try_divide((n1 - 1) * var1 + (n2 - 1) * var2, n1 + n2 - 2))
    return (
        F.when((n1 < 2) | (n2 < 2), F.lit(None).cast("double"))
        .when(pooled == 0, 0.0)
        .otherwise(F.try_divide(mean1 - mean2, pooled))
    )


def effect_label(effect: Column) -> Column:
    """T8."""
    size = F.abs(effect)
    return (
        F.when(effect.isNull() | F.isnan(effect), "n/a")
        .when(size < 0.2, "negligible")
        .when(size < 0.5, "small")
        .when(size < 0.8, "medium")
        .otherwise("large")
    )


def pooled_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """T4: two-proportion z with pooled standard error, 0 when the error is 0."""
    pool = (x1 + x2).cast("double") / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return F.when(se > 0, (x1 / n1 - x2 / n2) / se).otherwise(0.0)


def deltas(a: Column, b: Column) -> dict[str, Column]:
    """Percent change, absolute change and ratio, null when a is 0."""
    return {"pct_change": ratio((b - a) * 100.0, a), "change": b - a, "ratio": ratio(b, a)}


def percentage_points_tie(delta_pp: Column, tie: float = 3.0) -> Column:
    """Direction of a difference in percentage points, tie within +-3."""
    return F.when(F.abs(delta_pp) < tie, "tie").when(delta_pp > 0, "b").otherwise("a")
