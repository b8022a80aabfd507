"""Exact ranks, quantiles and rank sums without a global sort in one task.

``percentile`` and ``median`` keep every distinct value of a group in a single
aggregation buffer. Here values are first counted (one row per group and
distinct value), then scanned in value ranges. Each group has borders of its
own, from a quantile sketch over its counted rows, and as many ranges as those
rows need; a group of fewer than ``ROWS`` rows is one range. The sketch only
balances the work: the result is exact whatever the borders are. Whole numbers
stay whole numbers, so neighbours above 2**53 are told apart. A null group is a
group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.operators import scan as S

def ranked(
    df: DataFrame,
    groups: list[str],
    value: str,
    counts: dict[str, Column] | None = None,
    blocks: int = S.RANGE_BLOCKS,
    keep_block: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """One row per (group, value): ``n`` rows, ``below`` rows with a smaller value,
    ``size`` and ``amount`` (sum of values) of the group.

    ``counts`` adds further conditional row counts per value, each with its own
    ``<name>_below``, ``<name>_size`` and ``<name>_amount``.
    """
    counts = counts or {}
    whole = df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    typed = df.withColumn(value, F.col(value).cast("long" if whole else "double"))
    known = F.col(value).isNotNull() if whole else F.col(value).isNotNull() & ~F.isnan(value)
    counted = typed.where(known).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in counts.items()]
    )
    return ranked_counts(counted, groups, value, list(counts), blocks, keep_block, rows)


def ranked_counts(
    counted: DataFrame,
    groups: list[str],
    value: str,
    counts: list[str],
    blocks: int = S.RANGE_BLOCKS,
    keep_block: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """``ranked`` from rows that are counted already: groups, value, ``n`` and the columns ``counts``, one row per value."""
    columns = [F.col(c) for c in ["n", *counts]]
    some = F.greatest(*columns) if counts else columns[0]
    met = S.with_ranges(counted, groups, value, some > 0, rows, blocks)
    number = F.col(value).cast("double")
    out = S.ordered(
        met, groups, [value], F.col("_block"),
        below=S.total_before(F.col("n")), size=S.overall(F.col("n")),
        amount=S.overall(number * F.col("n")),
        **{f"{k}_below": S.total_before(F.col(k)) for k in counts},
        **{f"{k}_size": S.overall(F.col(k)) for k in counts},
        **{f"{k}_amount": S.overall(number * F.col(k)) for k in counts},
    )
    return out if keep_block else out.drop("_block")


def at_rank(value: str, rank: Column, of: str = "") -> Column:
    """Aggregate: the value holding the 0-based ``rank`` in a ``ranked`` table.

    ``of`` names one of the extra counts; the rank is then taken among its rows.
    """
    below, n = (F.col(f"{of}_below"), F.col(of)) if of else (F.col("below"), F.col("n"))
    hit = (below <= rank) & (rank < below + n)
    return F.max(F.when(hit, F.col(value)))


def percentile_agg(value: str, p: float, of: str = "") -> Column:
    """Linear interpolation between the two neighbouring ranks."""
    size = F.col(f"{of}_size") if of else F.col("size")
    h = (size - 1) * F.lit(float(p))
    lo, hi = F.floor(h), F.ceil(h)
    low, high = at_rank(value, lo, of), at_rank(value, hi, of)
    part = F.max(h - lo)
    return (low + (high - low) * part).cast("double")


def nearest_rank_agg(value: str, p: float) -> Column:
    """Index int(p * (n - 1) + 0.5) of the sorted values."""
    return at_rank(value, F.floor((F.col("size") - 1) * F.lit(float(p)) + 0.5)).cast("double")


PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float] | None = None,
              nearest: bool = False) -> DataFrame:
    """Percentiles per group."""
    agg = nearest_rank_agg if nearest else percentile_agg
    table = ranked(df, groups, value)
    return table.groupBy(*groups).agg(*[agg(value, p).alias(k) for k, p in (probs or PERCENTILES).items()])


def summary_stats(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """A10: count, mean, median, sample deviation and percentiles per group.

    All moments come from the counted values, so the input is read once.
    """
    v, n = F.col(value), F.col("n")
    table = ranked(df, groups, value)
    mean = F.col("amount") / F.col("size")
    spread = F.sum(n * (v - mean) * (v - mean))
    return table.groupBy(*groups).agg(
        F.sum(n).alias("count"),
        F.max(mean).alias("mean"),
        percentile_agg(value, 0.5).alias("median"),
        F.when(F.max("size") >= 2, F.sqrt(spread / (F.max("size") - 1))).alias("stdev"),
        *[percentile_agg(value, p).alias(k) for k, p in PERCENTILES.items()],
    )


def terciles(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Cut points sorted[n // 3] and sorted[2n // 3] of the positive values, 0 for n < 3."""
    table = ranked(df.where(F.col(value) > 0), groups, value)
    size = F.col("size")
    enough = F.max(size) >= 3
    return table.groupBy(*groups).agg(
        F.when(enough, at_rank(value, F.floor(size / 3)).cast("double")).otherwise(0.0).alias("t1"),
        F.when(enough, at_rank(value, F.floor(size * 2 / 3)).cast("double")).otherwise(0.0).alias("t2"),
    )
