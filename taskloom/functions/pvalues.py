"""P-values of finished test rows (one row per test), as Arrow UDFs.

Spark has no ``erf`` and no incomplete gamma function. The inputs are the
sufficient statistics that Spark computed over all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi_square_sf(x: float, dof: float) -> float:
    return gamma_q(dof / 2.0, x / 2.0)


def _partitions(small: int) -> tuple[int, list[int]]:
    """(period, numerator): the numbers of partitions of at most k into parts of at most ``small`` have
    the generating function numerator(q) / (1 - q**period)**(small + 1)."""
    period = math.lcm(*range(1, small + 1))
    top = np.zeros((small + 1) * period, object)
    top[0] = 1
    for part in [1, *range(1, small + 1)]:
        # times (1 - q**period) / (1 - q**part)
        for r in range(part):
            top[r::part] = np.cumsum(top[r::part])
        top[period:] = top[period:] - top[:-period]
    return period, top.tolist()


def exact_u_upper(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, in whole numbers and a number of steps that does not depend on the larger side.

    U <= k counts partitions of at most k into ``small`` parts of at most ``large``;
    the upper bound of the parts is taken in by inclusion and exclusion.
    """
    small, large = min(n1, n2), max(n1, n2)
    period, top = _partitions(small)

    def unbounded(k: int) -> int:
        return sum(top[j] * math.comb((k - j) // period + small, small) for j in range(k % period, min(k + 1, len(top)), period))

    # weight by which each total of large + i, i distinct in 1..small, goes in
    terms = {0: 1}
    for i in range(1, small + 1):
        for total, sign in list(terms.items()):
            terms[total + large + i] = terms.get(total + large + i, 0) - sign
    k = small * large - math.ceil(u)
    return sum(sign * unbounded(k - total) for total, sign in terms.items() if total <= k) / math.comb(small + large, small)


def mann_whitney_p(u: float, n1: float, n2: float, ties: float) -> float:
    """Two-sided: exact when one side has at most 8 values and there are no ties,
    else normal with tie and continuity correction."""
    top = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= 8:
        return min(1.0, 2 * exact_u_upper(top, int(n1), int(n2)))
    n = n1 + n2
    spread = math.sqrt(max(0.0, n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))))
    if spread == 0:
        return 1.0
    z = (top - n1 * n2 / 2.0 - 0.5) / spread
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def _chi_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_sf(a, b) if b > 0 else float("nan") for a, b in zip(x, dof)])


@F.pandas_udf(DoubleType())
def _z_p(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided)


@F.pandas_udf(DoubleType())
def _u_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p(*r) for r in zip(u, n1, n2, ties)])


def chi_square_p(chi2: Column, dof: Column) -> Column:
    return _chi_p(chi2, dof)


def z_p(z: Column) -> Column:
    return _z_p(z)


def u_p(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    return _u_p(u, n1.cast("double"), n2.cast("double"), ties)
