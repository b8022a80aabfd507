"""Statistics against textbook values, closed forms and brute force."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.config import CrossCut, Measurements
from taskloom.functions import numbers as N
from taskloom.functions import pvalues as PV
from taskloom.operators import abtests as AB
from taskloom.operators import bootstrap as B
from taskloom.operators import ranks as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalar_p_values():
    assert PV.chi_square_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert PV.chi_square_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert PV.chi_square_sf(0, 3) == 1.0
    assert PV.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    # U distribution for 5 and 5: P(U >= 25) = 1/252
    assert PV.exact_u_upper(25, 5, 5) == pytest.approx(1 / 252)
    assert PV.exact_u_upper(0, 5, 5) == pytest.approx(1.0)


def test_exact_u_equals_enumeration():
    from itertools import combinations
    n1, n2 = 4, 6
    us = [sum(r) - n1 * (n1 + 1) / 2 for r in combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 1):
        assert PV.exact_u_upper(u, n1, n2) == pytest.approx(sum(x >= u for x in us) / len(us))


def test_wilson_and_effects(spark):
    p, lo, hi = N.wilson(F.lit(8), F.lit(10))
    z0, z1, z2 = N.wilson(F.lit(0), F.lit(0))
    r = one(spark, p=p, lo=lo, hi=hi, z0=z0, z1=z1, z2=z2, h=N.cohens_h(F.lit(0.5), F.lit(0.2)),
            d=N.cohens_d(F.lit(10), F.lit(5.0), F.lit(4.0), F.lit(10), F.lit(3.0), F.lit(4.0)),
            label=N.effect_label(F.lit(-0.6)), z=N.pooled_z(F.lit(30), F.lit(100), F.lit(45), F.lit(100)))
    assert (r.p, round(r.lo, 4), round(r.hi, 4)) == (0.8, 0.4902, 0.9433)
    assert (r.z0, r.z1, r.z2) == (0, 0, 0)
    assert r.h == pytest.approx(2 * math.asin(math.sqrt(.5)) - 2 * math.asin(math.sqrt(.2)))
    assert r.d == pytest.approx(1.0) and r.label == "medium"
    assert r.z == pytest.approx(-2.1909, abs=1e-4)


def test_chi_square_textbook(spark):
    cells = spark.createDataFrame([("overall", "f", "x", 10, 20), ("overall", "f", "y", 20, 10),
                                   ("overall", "g", "x", 10, 20), ("overall", "g", "y", 20, 10), ("overall", "g", "z", 6, 6)],
                                  "slice string, field string, value string, o_a long, o_b long")
    got = {r.field: r for r in AB.chi_square(cells).collect()}
    assert got["f"].statistic == pytest.approx(5.4) and got["f"].dof == 1  # with Yates correction
    assert got["g"].statistic == pytest.approx(6.6667, abs=1e-4) and got["g"].dof == 2
    assert got["f"].effect == pytest.approx(math.sqrt(5.4 / 60))


def test_mann_whitney_and_slices(spark):
    rng = random.Random(3)
    rows = [("a" if i % 2 else "b", rng.choice(["x", "y"]), float(rng.randint(0, 12)) + (1.0 if i % 2 else 0.0)) for i in range(90)]
    rows += [("a", "rare", 1.0)] * 2
    df = spark.createDataFrame(rows, "cohort string, kind string, v double")
    cfg = Measurements((), ("v",), {}, (CrossCut("overall"), CrossCut("kind", "kind", ("x", "y", "rare"))), {"speed": ("v",)})
    got = {r.slice: r for r in AB.run_tests(df, ("a", "b"), cfg).collect()}
    assert set(got) == {"overall", "kind:x", "kind:y"}
    for name, t in got.items():
        a = [v for c, k, v in rows if c == "a" and name in ("overall", f"kind:{k}")]
        b = [v for c, k, v in rows if c == "b" and name in ("overall", f"kind:{k}")]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        assert t.statistic == pytest.approx(u)
        assert t.median_a == pytest.approx(statistics.median(a)) and t.std_b == pytest.approx(statistics.stdev(b))
        n1, n2, n = len(a), len(b), len(a) + len(b)
        ties = sum(c ** 3 - c for c in (sum(v == w for w in a + b) for v in set(a + b)))
        s = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / s
        assert t.p_value == pytest.approx(min(1, math.erfc(z / math.sqrt(2))))
        assert t.theme == "speed"


def test_adjust_properties(spark):
    rng = random.Random(5)
    ps = [rng.random() ** 3 for _ in range(200)] + [0.01] * 5
    df = spark.createDataFrame(list(enumerate(ps)), "id int, p_value double")
    got = {r.id: r for r in AB.adjust(df).collect()}
    m, order = len(ps), sorted(range(len(ps)), key=lambda i: ps[i])
    best = 1.0
    for rank in range(m, 0, -1):
        best = min(best, ps[order[rank - 1]] * m / rank)
        if rank == m or ps[order[rank]] != ps[order[rank - 1]]:
            want = best
        assert got[order[rank - 1]].p_adjusted == pytest.approx(want)
    by_p = sorted(got.values(), key=lambda r: r.p_value)
    assert all(x.p_adjusted <= y.p_adjusted for x, y in zip(by_p, by_p[1:]))
    assert all(r.bonferroni_significant == (r.p_value < 0.05 / m) for r in got.values())


@pytest.mark.parametrize("blocks", [2, 8])
def test_ranks_with_a_hot_value(spark, blocks):
    rng = random.Random(7)
    rows = [("hot", 1.5)] * 400 + [("hot", rng.gauss(0, 100)) for _ in range(300)] + [("b", float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, v double")
    table = R.ranked(df, ["g"], "v", blocks=blocks)
    got = {r.g: r for r in table.groupBy("g").agg(
        *[R.percentile_agg("v", p).alias(k) for k, p in R.PERCENTILES.items()], F.sum("n").alias("n")).collect()}
    for g in ("hot", "b"):
        values = [v for k, v in rows if k == g]
        assert got[g].n == len(values)
        for k, p in R.PERCENTILES.items():
            assert got[g][k] == pytest.approx(np.percentile(values, 100 * p))


def test_ranks_of_a_narrow_hot_group_and_a_null_group(spark):
    rng = random.Random(8)
    rows = [("narrow", 1000 + i * 1e-6) for i in range(900)] + [(None, rng.gauss(0, 1e6)) for _ in range(500)] + [("few", float(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, v double")
    table = R.ranked(df, ["g"], "v", blocks=8, rows=32, keep_block=True).collect()
    for g, least in (("narrow", 20), (None, 12), ("few", 1)):
        values = sorted(v for k, v in rows if k == g)
        own = sorted((r for r in table if r.g == g), key=lambda r: r.v)
        assert [r.below for r in own] == [sum(x < r.v for x in values) for r in own] and {r.size for r in own} == {len(values)}
        blocks = [r._block for r in own]
        assert blocks == sorted(blocks) and len(set(blocks)) >= least
        assert max(blocks.count(b) for b in blocks) <= 3 * 32
    got = {r.g: r.median for r in R.summary_stats(df, ["g"], "v").collect()}
    assert got[None] == pytest.approx(statistics.median(v for k, v in rows if k is None))


def test_ranks_of_long_numbers(spark):
    big = 2**60
    df = spark.createDataFrame([("a", big + i) for i in (3, 1, 2, 2, 0)], "g string, v long")
    got = sorted((r.v - big, r.n, r.below) for r in R.ranked(df, ["g"], "v").collect())
    assert got == [(0, 1, 0), (1, 1, 1), (2, 2, 2), (3, 1, 4)]


def test_bootstrap_mean_close_to_theory(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(10, 4, 9000)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)] + [("few", 0, 1.0), ("few", 1, 3.0)],
                               "g string, id int, v double")
    got = {r.g: r for r in B.mean_interval(df, ["g"], "v", "id", 1000).collect()}
    se = values.std(ddof=1) / math.sqrt(len(values))
    assert got["g"].mean == pytest.approx(values.mean())
    assert got["g"].ci_lower == pytest.approx(values.mean() - 1.96 * se, abs=0.35 * se)
    assert got["g"].ci_upper == pytest.approx(values.mean() + 1.96 * se, abs=0.35 * se)
    assert got["few"].ci_lower is None or math.isnan(got["few"].ci_lower)
    by_index = {r.g: r for r in B.mean_interval(df, ["g"], "v", "id", 200, by_index=True).collect()}
    assert by_index["few"].ci_lower == by_index["few"].mean == 2.0


def test_bootstrap_median_close_to_resampling(spark):
    rng = np.random.default_rng(1)
    values = rng.exponential(5, 301)
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = B.median_interval(df, ["g"], "v").first()
    medians = [np.median(rng.choice(values, len(values))) for _ in range(4000)]
    lo, hi = np.percentile(medians, [2.5, 97.5])
    near = np.sort(values)
    def rank(x):
        return int(np.searchsorted(near, x))
    assert abs(rank(got.ci_lower) - rank(lo)) <= 2 and abs(rank(got.ci_upper) - rank(hi)) <= 2


def test_stratified_sample(spark):
    df = spark.range(1000).selectExpr("id", "case when id < 900 then 'big' when id < 999 then 'small' else 'one' end as s")
    got = {r.s: r["count"] for r in AB.stratified_sample(df, "s", "id", 100).groupBy("s").count().collect()}
    assert got == {"big": 90, "small": 9, "one": 1}


def brute_quotas(sizes, n):
    total, strata = sum(sizes.values()), len(sizes)
    n = min(n, total)
    order = lambda score: sorted(sizes, key=lambda k: (-score[k], k is None, k or ""))
    if n < strata:
        first = order({k: v for k, v in sizes.items()})[:n]
        return {k: int(k in first) for k in sizes}
    part = {k: n * v // total for k, v in sizes.items()}
    quota, over = {k: max(1, x) for k, x in part.items()}, {k: (n * v % total if part[k] else 0) for k, v in sizes.items()}
    if sum(quota.values()) > n:
        rest, left = n - strata, max(1, total - strata)
        quota, over = {k: 1 + rest * (v - 1) // left for k, v in sizes.items()}, {k: rest * (v - 1) % left for k, v in sizes.items()}
    for k in order(over)[:n - sum(quota.values())]:
        quota[k] += 1
    return quota


@pytest.mark.parametrize("n", [1, 3, 7, 23, 100, 333, 5000])
def test_sample_fills_its_quotas(spark, n):
    sizes = {"a": 400, "b": 300, None: 120, "c": 60, "d": 7, "e": 1, "f": 1}
    rows = [(1000 * j + i, s, i % 2 == 0) for j, (s, size) in enumerate(sizes.items()) for i in range(2 * size)]
    df = spark.createDataFrame(rows, "id long, s string, good boolean")
    got = AB.stratified_sample(df, "s", "id", n, eligible=F.col("good")).collect()
    want = brute_quotas(sizes, n)
    assert {k: sum(r.s == k for r in got) for k in sizes} == want and sum(want.values()) == min(n, sum(sizes.values()))
    assert all(r.good for r in got) and len({r.id for r in got}) == len(got)
    import hashlib
    code = lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest()
    for s in sizes:
        own = sorted((r[0] for r in rows if r[1] == s and r[2]), key=code)
        assert {r.id for r in got if r.s == s} == set(own[:want[s]])
    again = AB.stratified_sample(df, "s", "id", n, eligible=F.col("good"), taken=spark.createDataFrame([(r.id,) for r in got], "id long"))
    assert not {r.id for r in again.collect()} & {r.id for r in got}


def test_sample_of_nothing_and_of_a_share(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, 'x') as s")
    assert AB.stratified_sample(df.limit(0), "s", "id", 5).collect() == []
    assert AB.stratified_sample(df, "s", "id", share=0.1).count() == 100


def brute_weights(ident, resamples, seed=42):
    import hashlib
    digest = hashlib.md5(f"{ident}:{seed}".encode()).hexdigest()
    low, high, mask, out = int(digest[:8], 16), int(digest[8:16], 16), 2**32 - 1, []
    for b in range(1, resamples + 1):
        h = (low + b * B.STEP) & mask
        h = ((h ^ h >> 16) * B.FIRST) & mask
        h = ((h ^ h >> 13 ^ high) * B.SECOND) & mask
        h ^= h >> 16
        out.append(sum(h >= t for t in B.POISSON))
    return out


@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_bootstrap_equals_plain_resampling(spark, monkeypatch, piece):
    monkeypatch.setattr(B, "PIECE", piece)
    rows = [(None if i % 5 == 0 else "g", None if i % 4 == 0 else i % 3, f"r{i}", None if i % 11 == 0 else float(i * i % 97), float(i)) for i in range(200)]
    df = spark.createDataFrame([*rows, ("few", 1, "x", 1.0, 2.0), ("none", 1, "y", None, 3.0)], "g string, k long, id string, v double, w double")
    got = {(r.g, r.k): r for r in B.mean_intervals(df, ["g", "k"], ["v", "w"], "id", 200, by_index=True).collect()}
    for key in {(r[0], r[1]) for r in rows}:
        for name, at in (("v", 3), ("w", 4)):
            own = [(brute_weights(r[2], 200), r[at]) for r in rows if (r[0], r[1]) == key and r[at] is not None]
            means = sorted(sum(w[b] * v for w, v in own) / n for b in range(200) if (n := sum(w[b] for w, _ in own)))
            r = got[key][name]
            assert r.n == len(own) and r.mean == pytest.approx(sum(v for _, v in own) / len(own))
            assert r.ci_lower == pytest.approx(means[int(len(means) * 0.025)]) and r.ci_upper == pytest.approx(means[int(len(means) * 0.975)])
    assert got["few", 1].v.ci_lower == 1.0 and got["none", 1].v is None and got["none", 1].w.mean == 3.0


def test_poisson_weights():
    rng = np.random.default_rng(4)
    w = B.weights(rng.integers(0, 2**32, 2000), rng.integers(0, 2**32, 2000), 500).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.02)
    # neighbouring resamples and rows are unrelated
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def test_null_groups_stay(spark):
    from taskloom.operators import dataset as D
    from taskloom.operators import timing as TM
    df = spark.createDataFrame([(g, float(i), i) for g in ("a", None) for i in range(3)], "g string, v double, i long")
    assert {r.g: (r.n, r.median) for r in B.median_interval(df, ["g"], "v").collect()} == {"a": (3, 1.0), None: (3, 1.0)}
    assert TM.first_requests(df, ["g"], ["v", "i"]).where("is_first").count() == 2
    assert {(r.g, r.i): r.pct for r in D.distribution(df, ["g"], "i").collect()}[None, 1] == pytest.approx(100 / 3)


def test_sensitivity_labels(spark):
    rows = [(0.1, 0.2, True, True), (0.1, 0.2, True, False), (0.1, -0.2, True, True), (0.0, -0.2, False, False)]
    df = spark.createDataFrame(rows, "f double, r double, fs boolean, rs boolean")
    got = [r[0] for r in df.select(AB.agreement(F.col("f"), F.col("r"), F.col("fs"), F.col("rs"))).collect()]
    assert got == ["agree", "weak", "DIVERGE", "agree"]


def test_exact_u_has_no_size_limit():
    near = PV.exact_u_upper(6_000, 8, 1_000)
    assert PV.exact_u_upper(6_000_000_000, 8, 1_000_000_000) == pytest.approx(near, rel=0.05)
    assert PV.mann_whitney_p(7_999_999, 8, 1_000_000, 0) == pytest.approx(2 * 2 / math.comb(1_000_008, 8))


def test_binomial_tail_is_one_formula_at_every_size():
    for n in (3, 4, 101, 2001, 2500):
        for k in range(1, n, max(1, n // 7)):
            p, need = k / n, n // 2 + 1
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
                                 + (n - i) * math.log1p(-p)) for i in range(need, n + 1))
            assert B._tail(n, k, need) == pytest.approx(exact, abs=1e-9)


def test_regrouped_intervals_equal_those_of_every_group(spark):
    """Rows drawn once in the finest groups give the intervals that each coarser group gives by itself."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), str(i), rng.random() if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k string, id string, v double")
    deal = lambda t: t.selectExpr("*", "inline(array(struct('all' as s, 'all' as name), struct('k' as s, coalesce(k, 'unknown') as name)))")
    def ends(found):
        return sorted((r.g, r.s, r.name, r.v.n, *(round(x, 9) for x in (r.v.mean, r.v.ci_lower, r.v.ci_upper))) for r in found.collect())
    once = ends(B.mean_intervals(df, ["g", "k"], ["v"], "id", 200, by_index=True, regroup=(deal, ["g", "s", "name"])))
    each = ends(B.mean_intervals(deal(df), ["g", "s", "name"], ["v"], "id", 200, by_index=True))
    assert once == each and len(once) == 8


def test_weights_count_the_borders_below():
    rng = np.random.default_rng(3)
    low, high = rng.integers(0, 2**32, 500), rng.integers(0, 2**32, 500)
    h = (low[:, None] + np.arange(1, 401) * B.STEP) % 2**32
    h = (h ^ h >> 16) * B.FIRST % 2**32
    h = ((h ^ h >> 13) ^ high[:, None]) * B.SECOND % 2**32
    h ^= h >> 16
    assert (B.weights(low, high, 400) == sum((h >= t).astype(int) for t in B.POISSON)).all()
