"""Bootstrap intervals whose rows are never multiplied by the number of resamples.

Mean: in resample b a row counts as often as a Poisson(1) number says, which a
counter-based hash of (row, b) yields. Rows are dealt to pieces of about
``PIECE`` rows; a piece folds its rows into two vectors, one entry per resample:
the sum of weights and the sum of weighted values. Pieces of one group are added
entry by entry with partial aggregates, so a group of any size takes the same
path and no row is left out or merged with others beforehand. A resample that
drew no row has no mean and is left out. The hash begins with MD5 of the row id:
two rows that share all its bits share their weights, nothing else.

Median: as the number of resamples grows, the bootstrap distribution of a
median has a closed form over order statistics, so the interval ends are the
values at two ranks and come from an exact rank scan.

A null group key is a group like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from taskloom.operators import ranks as R
from taskloom.operators import scan as S

#: Rows of a group that one task folds at a time.
PIECE = 1 << 16
#: Rows whose weights are in memory at once.
STRIP = 64
#: Of 2**32 hash values, those below the k-th entry give a weight of at most k: the distribution function of Poisson(1).
POISSON = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Odd multipliers of the counter hash.
STEP, FIRST, SECOND = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35


def weights(low: np.ndarray, high: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(1) numbers of every row (two 32-bit words of its hash) in every resample."""
    with np.errstate(over="ignore"):
        h = low.astype(np.uint32)[:, None] + np.arange(1, resamples + 1, dtype=np.uint32) * np.uint32(STEP)
        h ^= h >> np.uint32(16)
        h *= np.uint32(FIRST)
        h ^= h >> np.uint32(13)
        h ^= high.astype(np.uint32)[:, None]
        h *= np.uint32(SECOND)
        h ^= h >> np.uint32(16)
    w = np.zeros(h.shape, np.uint8)
    for border in POISSON[:3]:
        w += h >= np.uint32(border)
    # one row and resample in fifty weighs more
    flat, out = h.ravel(), w.ravel()
    more = np.flatnonzero(flat >= np.uint32(POISSON[3]))
    out[more] = 3 + np.searchsorted(np.array(POISSON[3:], np.uint32), flat[more], side="right")
    return w


def words_of(ident: Column, seed: int) -> tuple[Column, Column]:
    """Two 32-bit words of the MD5 of id and seed."""
    digest = F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(seed))))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def mean_intervals(df: DataFrame, keys: list[str], values: list[str], ident: str, resamples: int = 5000,
                   alpha: float = 0.05, by_index: bool = False, seed: int = 42, regroup=None) -> DataFrame:
    """T9 or T10 of several columns at once: keys and, per value, a struct (n, mean, ci_lower, ci_upper).

    ``regroup`` (a function of a frame, and the keys of its result) asks for
    coarser groups, several to a row if need be. A row has the same weights in
    all of them, so it is drawn once, in its group by ``keys``, and the vectors
    of these groups are what ``regroup`` deals out.

    T9: percentiles with interpolation, null for n < 3. T10 (``by_index``):
    order statistics, the mean itself for n < 3. Null values do not count.
    """
    typed = df.select(*keys, F.col(ident).alias("_id"), *[F.col(v).cast("double").alias(f"_{i}") for i, v in enumerate(values)])
    low, high = words_of(F.col("_id"), seed)
    sizes = typed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = S.join_keys(typed, sizes, keys).select(
        F.struct(*keys).alias("_key"), F.expr(f"cast(pmod(xxhash64(_id), ceil(_n / {PIECE})) as int)").alias("_piece"),
        low.alias("_low"), high.alias("_high"), *[f"_{i}" for i in range(len(values))])

    def fold(key: tuple[pa.Scalar, ...], piece: pa.Table) -> pa.Table:
        data = np.stack([piece.column(f"_{i}").to_numpy() for i in range(len(values))], axis=1)
        known = ~np.isnan(data)
        data = np.where(known, data, 0.0)
        lo, hi = piece.column("_low").to_numpy(), piece.column("_high").to_numpy()
        drawn, summed = np.zeros((len(values), resamples)), np.zeros((len(values), resamples))
        for at in range(0, len(data), STRIP):
            part = slice(at, at + STRIP)
            w = weights(lo[part], hi[part], resamples).astype(float)
            drawn += known[part].T.astype(float) @ w
            summed += data[part].T @ w
        kind = pa.struct([f.with_nullable(True) for f in key[0].type])
        return pa.table({
            "_key": pa.array([key[0].as_py()] * len(values), kind), "_value": pa.array(range(len(values)), pa.int32()),
            "_n": known.sum(axis=0).astype(np.int64), "_sum": data.sum(axis=0),
            "_drawn": pa.array(list(drawn), pa.list_(pa.float64())), "_summed": pa.array(list(summed), pa.list_(pa.float64()))})

    shape = df.select(F.struct(*keys).alias("_key")).schema["_key"].dataType.simpleString()
    folded = rows.groupBy("_key", "_piece").applyInArrow(
        fold, f"_key {shape}, _value int, _n long, _sum double, _drawn array<double>, _summed array<double>")
    if regroup:
        deal, keys = regroup
        dealt = deal(folded.select("_key.*", *[c for c in folded.columns if c != "_key"]))
        folded = dealt.select(F.struct(*keys).alias("_key"), *[c for c in folded.columns if c != "_key"])
    entries = folded.select("_key", "_value", "_n", "_sum", F.posexplode(F.arrays_zip("_drawn", "_summed"))).groupBy("_key", "_value", "pos").agg(
        F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), (F.sum("col._summed") / F.nullif(F.sum("col._drawn"), F.lit(0.0))).alias("_mean"))
    means = F.sort_array(F.collect_list("_mean"))  # one entry per resample
    done = entries.groupBy("_key", "_value").agg(F.first("_n").alias("_n"), F.first("_sum").alias("_sum"), means.alias("_means"))
    mean, enough = F.col("_sum") / F.nullif(F.col("_n"), F.lit(0)), F.col("_n") >= 3
    if by_index:
        ends = [F.when(enough, at_share(F.col("_means"), p)).otherwise(mean) for p in (alpha / 2, 1 - alpha / 2)]
    else:
        ends = [F.when(enough, interpolated(F.col("_means"), p)) for p in (alpha / 2, 1 - alpha / 2)]
    found = F.struct(F.col("_n").alias("n"), mean.alias("mean"), ends[0].alias("ci_lower"), ends[1].alias("ci_upper"))
    wide = done.groupBy("_key").agg(*[F.max(F.when((F.col("_value") == i) & (F.col("_n") > 0), found)).alias(v) for i, v in enumerate(values)])
    return wide.select(*[F.col("_key")[k].alias(k) for k in keys], *values)


def at_share(sorted_values: Column, p: float) -> Column:
    """Value at index int(size * p) of a sorted array."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) * F.lit(p)).cast("int"))


def interpolated(sorted_values: Column, p: float) -> Column:
    """Percentile of a sorted array by linear interpolation."""
    h = (F.size(sorted_values) - 1) * F.lit(p)
    low = F.get(sorted_values, F.floor(h).cast("int"))
    return low + (F.get(sorted_values, F.ceil(h).cast("int")) - low) * (h - F.floor(h))


def mean_interval(df: DataFrame, keys: list[str], value: str, ident: str, resamples: int = 5000,
                  alpha: float = 0.05, by_index: bool = False, seed: int = 42) -> DataFrame:
    """T9 or T10 of one column: keys, n, mean, ci_lower, ci_upper; groups without a value are left out."""
    found = mean_intervals(df, keys, [value], ident, resamples, alpha, by_index, seed)
    return found.where(F.col(value).isNotNull()).select(*keys, f"{value}.*")


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h, m, change = d, 0, 0.0
    while abs(change - 1) > 1e-14:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            change = c * d
            h *= change
    return scale * h


def _tail(n: int, k: int, need: int) -> float:
    """P(Binomial(n, k / n) >= need)."""
    if k >= n:
        return 1.0
    if k <= 0:
        return 0.0
    return beta_i(need, n - need + 1, k / n)


def median_ranks(n: int, alpha: float = 0.05) -> tuple[int, int]:
    """0-based ranks of the values that bound the resampled median."""
    need = n // 2 + 1
    def first(level: float) -> int:
        lo, hi = 1, n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if _tail(n, mid, need) >= level else (mid + 1, hi)
        return lo - 1
    return first(alpha / 2), first(1 - alpha / 2)


@F.pandas_udf(StructType([StructField("lo", LongType()), StructField("hi", LongType())]))
def _ranks(n: pd.Series) -> pd.DataFrame:
    cache = {k: median_ranks(int(k)) for k in n.unique()}
    return pd.DataFrame([cache[k] for k in n], columns=["lo", "hi"])


def median_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """T9 for the median; null for n < 3."""
    table = R.ranked(df, keys, value)
    sizes = table.groupBy(*keys).agg(F.max("size").alias("_n")).withColumn("_r", _ranks("_n"))
    joined = S.join_keys(table, sizes.drop("_n"), keys)
    enough = F.max("size") >= 3
    return joined.groupBy(*keys).agg(
        F.max("size").alias("n"), R.percentile_agg(value, 0.5).alias("median"),
        F.when(enough, R.at_rank(value, F.col("_r.lo")).cast("double")).alias("ci_lower"),
        F.when(enough, R.at_rank(value, F.col("_r.hi")).cast("double")).alias("ci_upper"))
