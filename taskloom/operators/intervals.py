"""Interval operators as sweeps.

Starts and ends become +1 / -1 steps on a time line and every question is a
prefix sum over the steps, computed in time ranges whose borders follow the step
times of each key: a busy day is cut finely, a quiet year is one range. No
operator joins intervals with each other, so long or heavily overlapping
sessions cost one step each.

Input: ``key`` columns (may be empty), ``session_id``, ``start_s``, ``end_s`` in
epoch seconds. Intervals with ``end_s <= start_s`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.operators import scan as S

def _valid(intervals: DataFrame) -> DataFrame:
    return intervals.where("end_s > start_s").withColumn("_all", F.lit(0))


def _steps(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (key, time, direction) with its count."""
    iv = _valid(intervals)
    ups = iv.select(*keys, F.col("start_s").alias("at"), F.lit(1).alias("delta"))
    downs = iv.select(*keys, F.col("end_s").alias("at"), F.lit(-1).alias("delta"))
    return ups.unionByName(downs).groupBy(*keys, "at", "delta").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "step", F.col("delta") * F.col("n"))


def _cut(moments: DataFrame, keys: list[str], guard: Column, width: float | None, rows: int | None) -> DataFrame:
    """moments with ``_block``: ranges that follow the data, or time blocks of a given width."""
    if width is not None:
        return moments.withColumn("_block", S.time_chunk(F.col("at"), width))
    return S.with_ranges(moments, keys, "at", guard, rows)


def concurrency(intervals: DataFrame, keys: list[str] | None = None, width: float | None = None, rows: int | None = None) -> DataFrame:
    """Highest concurrency and number of overlapping pairs.

    At equal times an end comes before a start, so touching intervals do not
    overlap. A start that meets ``active`` intervals adds that many pairs.
    """
    keys = [*(keys or []), "_all"]
    steps = _cut(_steps(intervals, keys), keys, (F.col("n") > 0) & (F.col("step") != 0), width, rows)
    swept = S.ordered(steps, keys, ["at", "delta"], F.col("_block"), before=S.total_before(F.col("step")))
    n, before = F.col("n"), F.col("before")
    pairs = F.when(F.col("delta") > 0, n * before + (n * (n - 1) / 2).cast("long")).otherwise(0)
    return swept.groupBy(*keys).agg(
        F.sum(F.when(F.col("delta") > 0, n)).alias("session_count"),
        F.sum(pairs).cast("long").alias("overlapping_pairs"),
        F.max(before + F.col("step")).alias("max_concurrency"),
    ).drop("_all")


def activity_periods(intervals: DataFrame, keys: list[str] | None = None, width: float | None = None, rows: int | None = None) -> DataFrame:
    """Merged periods (keys, period_start, period_end); touching intervals merge."""
    named = list(keys or [])
    keys = [*named, "_all"]
    steps = _cut(_steps(intervals, keys), keys, (F.col("n") > 0) & (F.col("step") != 0), width, rows)
    swept = S.ordered(steps.withColumn("_o", -F.col("delta")), keys, ["at", "_o"], F.col("_block"), before=S.total_before(F.col("step")))
    opens = (F.col("delta") > 0) & (F.col("before") == 0)
    closes = (F.col("delta") < 0) & (F.col("before") + F.col("step") == 0)
    borders = swept.where(opens | closes).select(
        *keys, "_block", "at", "_o", opens.alias("opens"), F.when(closes, F.col("at")).alias("closed"))
    paired = S.ordered(borders, keys, ["at", "_o"], F.col("_block"), period_end=S.next_after(F.col("closed")))
    return paired.where("opens").select(*named, F.col("at").alias("period_start"), "period_end")


def classify_gaps(gaps: DataFrame, intervals: DataFrame, width: float | None = None, rows: int | None = None) -> DataFrame:
    """Context switch when another session is active at the middle of the gap, else true idle.

    ``gaps``: session_id, gap_start_s, gap_end_s. The number of sessions active
    at a moment is a prefix sum; the own session is taken off by an equi-join.
    """
    middle = gaps.withColumn("mid", F.col("gap_start_s") + (F.col("gap_end_s") - F.col("gap_start_s")) / 2)
    iv = _valid(intervals)
    none = F.lit(None).cast("string")
    moments = (
        iv.select(F.lit(0).alias("_all"), F.col("start_s").alias("at"), F.lit(0).alias("o"), F.lit(1).alias("step"),
                  none.alias("session_id"), F.lit(None).cast("double").alias("gap_start_s"),
                  F.lit(None).cast("double").alias("gap_end_s"))
        .unionByName(iv.select(F.lit(0).alias("_all"), F.col("end_s").alias("at"), F.lit(2).alias("o"),
                               F.lit(-1).alias("step"), none.alias("session_id"),
                               F.lit(None).cast("double").alias("gap_start_s"),
                               F.lit(None).cast("double").alias("gap_end_s")))
        .unionByName(middle.select(F.lit(0).alias("_all"), F.col("mid").alias("at"), F.lit(1).alias("o"),
                                   F.lit(0).alias("step"), F.col("session_id").cast("string").alias("session_id"),
                                   "gap_start_s", "gap_end_s"))
    )
    cut = _cut(moments, ["_all"], F.col("step").isNotNull(), width, rows)
    swept = S.ordered(cut, ["_all"], ["at", "o"], F.col("_block"),
                      active=S.total_before(F.col("step"))).where("o = 1")
    own = iv.groupBy(F.col("session_id").cast("string").alias("session_id")).agg(
        F.min("start_s").alias("s"), F.max("end_s").alias("e"))
    seen = swept.join(own, "session_id", "left")
    mine = F.coalesce(((F.col("at") >= F.col("s")) & (F.col("at") <= F.col("e"))).cast("int"), F.lit(0))
    return seen.select(
        "session_id", "gap_start_s", "gap_end_s",
        (F.col("gap_end_s") - F.col("gap_start_s")).alias("gap_seconds"),
        F.when(F.col("active") - mine > 0, "context_switch").otherwise("true_idle").alias("gap_class"),
    )
