"""Ordered scans that survive hot keys.

A plain ``Window.partitionBy(session)`` puts every row of a session in one
task. Here the order of a session is cut into chunks (a block of message
indexes, an hour, a value range) and a running value is computed in two levels:

1. each (key, chunk) is reduced to one summary row with a partial aggregate,
2. a window over the *summary* rows yields what every chunk inherits,
3. a window over (key, chunk) finishes inside the chunk.

Only summary rows of one key meet in one task, so a key holding a third of all
rows is spread over as many tasks as it has chunks. The detail rows are
shuffled once, by (key, chunk). With ``chunk=None`` (keys of bounded size) the
same call is one ordinary window.

``chunk`` must not decrease along ``order``; key columns must not be null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

HOUR = 3600.0
BEFORE = (W.unboundedPreceding, -1)
UP_TO = (W.unboundedPreceding, 0)
AFTER = (1, W.unboundedFollowing)
ALL = (W.unboundedPreceding, W.unboundedFollowing)


@dataclass(frozen=True)
class Running:
    """One running value: how to sum up a chunk, inherit, finish, and join both."""

    summary: Callable[[Column], Column]
    inherit: Callable[[Column, WindowSpec], Column]
    inner: Callable[[WindowSpec], Column]
    join: Callable[[Column, Column], Column]
    alone: Callable[[Column], Column] = lambda inner: inner


def _plus(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    return F.coalesce(a, zero) + F.coalesce(b, zero)


def _sum(value: Column, frame: tuple[int, int]) -> Running:
    return Running(
        summary=lambda _o: F.sum(value),
        inherit=lambda s, w: F.sum(s).over(w.rowsBetween(*BEFORE)),
        inner=lambda w: F.sum(value).over(w.rowsBetween(*frame)),
        join=_plus,
        alone=lambda inner: F.coalesce(inner, F.lit(0)),
    )


def total(value: Column) -> Running:
    """Running sum, current row included."""
    return _sum(value, UP_TO)


def total_before(value: Column) -> Running:
    """Running sum of the earlier rows."""
    return _sum(value, BEFORE)


def position() -> Running:
    """1-based row number."""
    return total(F.lit(1).cast("long"))


def overall(value: Column) -> Running:
    """Sum over the whole key."""
    return Running(
        summary=lambda _o: F.sum(value),
        inherit=lambda s, w: F.sum(s).over(w.rowsBetween(*ALL)),
        inner=lambda w: F.sum(value).over(w.rowsBetween(*ALL)),
        join=lambda a, _b: a,
    )


def count_all() -> Running:
    return overall(F.lit(1).cast("long"))


def _max(value: Column, frame: tuple[int, int]) -> Running:
    return Running(
        summary=lambda _o: F.max(value),
        inherit=lambda s, w: F.max(s).over(w.rowsBetween(*BEFORE)),
        inner=lambda w: F.max(value).over(w.rowsBetween(*frame)),
        join=lambda a, b: F.greatest(a, b),
    )


def highest(value: Column) -> Running:
    return _max(value, UP_TO)


def highest_before(value: Column) -> Running:
    return _max(value, BEFORE)


def lowest_from(value: Column) -> Running:
    """Minimum of the current and all later rows."""
    return Running(
        summary=lambda _o: F.min(value),
        inherit=lambda s, w: F.min(s).over(w.rowsBetween(*AFTER)),
        inner=lambda w: F.min(value).over(w.rowsBetween(0, W.unboundedFollowing)),
        join=lambda a, b: F.least(a, b),
    )


def overall_max(value: Column) -> Running:
    return Running(
        summary=lambda _o: F.max(value),
        inherit=lambda s, w: F.max(s).over(w.rowsBetween(*ALL)),
        inner=lambda w: F.max(value).over(w.rowsBetween(*ALL)),
        join=lambda a, _b: a,
    )


def overall_min(value: Column) -> Running:
    return Running(
        summary=lambda _o: F.min(value),
        inherit=lambda s, w: F.min(s).over(w.rowsBetween(*ALL)),
        inner=lambda w: F.min(value).over(w.rowsBetween(*ALL)),
        join=lambda a, _b: a,
    )


def _last(value: Column, frame: tuple[int, int]) -> Running:
    return Running(
        summary=lambda o: F.max_by(value, F.when(value.isNotNull(), o)),
        inherit=lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(*BEFORE)),
        inner=lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(*frame)),
        join=lambda a, b: F.coalesce(b, a),
    )


def latest(value: Column) -> Running:
    """Last non-null value up to the current row."""
    return _last(value, UP_TO)


def latest_before(value: Column) -> Running:
    """Last non-null value of the earlier rows; ``lag`` when never null."""
    return _last(value, BEFORE)


def next_after(value: Column) -> Running:
    """First non-null value of the later rows; ``lead`` when never null."""
    return Running(
        summary=lambda o: F.min_by(value, F.when(value.isNotNull(), o)),
        inherit=lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(*AFTER)),
        inner=lambda w: F.first(value, ignorenulls=True).over(w.rowsBetween(*AFTER)),
        join=lambda a, b: F.coalesce(b, a),
    )


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | None,
    **running: Running,
) -> DataFrame:
    """Add one column per running value, computed along ``order`` within ``keys``."""
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[r.alone(r.inner(w)).alias(name) for name, r in running.items()])
    return along(pieces(df, keys, chunk), order, **running).select(*df.columns, *running)


#: Columns of ``pieces``: the key and the chunk of a row. Rows that keep them stay where a scan has put them.
PIECE = ["_key", "_chunk"]


def pieces(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """df with the columns ``PIECE`` (only the second without keys)."""
    # inside a struct, a null key or chunk equals another one, so its rows stay
    cut = df.withColumn("_chunk", F.struct(chunk.alias("at")))
    return cut.withColumn("_key", F.struct(*keys)) if keys else cut


def along(cut: DataFrame, order: list[str], **running: Running) -> DataFrame:
    """``ordered`` on a frame that comes from ``pieces``, and keeps its columns: a second scan over the same pieces needs no further shuffle of the rows."""
    part = [c for c in PIECE if c in cut.columns]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    summary = cut.groupBy(*part).agg(
        *[r.summary(by).alias(f"_s_{name}") for name, r in running.items()]
    )
    between = W.partitionBy(*part[:-1]).orderBy("_chunk")
    carry = summary.select(
        *part, *[r.inherit(F.col(f"_s_{name}"), between).alias(f"_c_{name}") for name, r in running.items()]
    )
    inside = W.partitionBy(*part).orderBy(*order)
    return cut.join(carry, part).select(
        *cut.columns,
        *[r.join(F.col(f"_c_{name}"), r.inner(inside)).alias(name) for name, r in running.items()],
    )


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key meets a null key; the keys come from ``left``."""
    other = right.select(F.struct(*keys).alias("_key"), *[c for c in right.columns if c not in keys])
    return left.withColumn("_key", F.struct(*keys)).join(other, "_key", how).drop("_key")


#: Rows of a range, and the square root of the largest number of ranges of a key.
RANGE_ROWS, RANGE_BLOCKS = 8192, 24


def with_ranges(df: DataFrame, keys: list[str], value: str, guard: Column, rows: int | None = None, blocks: int = RANGE_BLOCKS,
                name: str = "_block") -> DataFrame:
    """df with the number of the value range that each row falls into: chunks whose borders follow the data of each key.

    A key of more than ``rows`` rows gets borders from a quantile sketch over
    its own values, as many as its rows need, so a busy day or a narrow group is
    cut as finely as any other; all other keys are one range. The borders only
    balance the work. ``guard`` holds for every row and names the columns that
    are otherwise unused, so that sketch and scan read one exchange.
    """
    n = blocks * blocks
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.percentile_approx(F.when(guard, F.col(value)), probs, F.lit(4 * n)).alias("_borders"))
    found = found.where(F.col("_rows") > (rows or RANGE_ROWS)).select(
        *keys, F.least(F.lit(n), F.ceil(F.col("_rows") / (rows or RANGE_ROWS))).alias("_ranges"), "_borders")
    met = join_keys(df, found, keys, "left")
    # binary search, one generated step per power of two; functions of array elements would be interpreted
    met = met.withColumn("_above", F.lit(0))
    for step in (1 << k for k in reversed(range((n - 1).bit_length()))):
        met = met.withColumn("_above", F.col("_above") + F.when(F.get("_borders", F.col("_above") + (step - 1)) < F.col(value), step).otherwise(0))
    number = F.when(F.col("_borders").isNull(), 0).otherwise(F.floor(F.col("_above") * F.col("_ranges") / n)).cast("int")
    return met.withColumn(name, number).drop("_borders", "_ranges", "_above")


def with_name_ranges(names: DataFrame, column: str, borders: int = 1023, name: str = "_block") -> DataFrame:
    """names with the number of the range of a string column, among borders drawn from the names themselves.

    The borders are the ``borders`` names of smallest hash, so names with a long
    common prefix are cut as finely as any others.
    """
    drawn = names.select(column).distinct().orderBy(F.xxhash64(column), column).limit(borders)
    found = drawn.agg(F.array_sort(F.collect_list(column))).scalar()
    return names.withColumn("_borders", found).withColumn(
        name, F.size(F.filter("_borders", lambda b: b < F.col(column)))).drop("_borders")


def index_chunk(column: str, size: int = 4096) -> Column:
    """At most ``size`` message indexes per chunk."""
    return F.floor(F.col(column) / size)


def time_chunk(seconds: Column, width: float = 3600.0) -> Column:
    """Fixed time blocks."""
    return F.floor(seconds / width)


def epoch_seconds(column: str) -> Column:
    """Seconds since 1970 with microseconds, for both timestamp types."""
    return F.expr(
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))"
    ) / F.lit(1e6)


def epoch_seconds_of(moment: Column) -> Column:
    """``epoch_seconds`` for an expression of TIMESTAMP type in a UTC session."""
    return F.unix_micros(moment) / F.lit(1e6)


def seconds_between(start: str, end: str) -> Column:
    return F.expr(
        f"timestampdiff(MICROSECOND, cast({start} as timestamp_ntz), cast({end} as timestamp_ntz))"
    ) / F.lit(1e6)
