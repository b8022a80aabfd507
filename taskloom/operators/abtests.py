"""A/B tests over all slices in one pass.

Rows are expanded once to (slice, kind, field, value) and folded to two counts,
one per cohort, in the mapper: a category becomes a cell, a predicate a hit or
a miss, a number a value with its counts, the row itself a member of the slice.
This table of counts is all that is shuffled and, written as a stage, all that
the tests read: the input is scanned once, whatever the number of fields,
slices and tests. The hot ``overall`` slice shrinks to its distinct values,
which ``ranks`` spreads over value ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taskloom.config import Measurements
from taskloom.functions import numbers as N
from taskloom.functions import pvalues as PV
from taskloom.operators import ranks as R
from taskloom.operators import scan as S
from taskloom.sources.stage import stage as write_stage

TEST = ["slice", "field"]
CATEGORY, NUMBER, HIT, MEMBER = "category", "number", "hit", "member"


def counts(df: DataFrame, cohorts: tuple[str, str], cfg: Measurements, kinds: tuple[str, ...] = (CATEGORY, NUMBER, HIT, MEMBER)) -> DataFrame:
    """slice, kind, field, text, number, o_a, o_b: how many rows of each cohort have the value. P26: a null predicate is a miss."""
    a, b = cohorts
    none = F.lit(None).cast("string"), F.lit(None).cast("double")
    def cell(kind: str, field: str, text: Column, number: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), text.alias("text"), number.alias("number"))
    cells = [cell(CATEGORY, f, F.col(f).cast("string"), none[1]) for f in cfg.categorical if CATEGORY in kinds]
    cells += [cell(NUMBER, f, none[0], F.col(f).cast("double")) for f in cfg.continuous if NUMBER in kinds]
    cells += [cell(HIT, name, F.coalesce(F.col(f).cast("string") == F.lit(v), F.lit(False)).cast("string"), none[1])
              for name, (f, v) in cfg.proportions.items() if HIT in kinds]
    cells += [cell(MEMBER, "", F.lit(""), none[1])] if MEMBER in kinds else []
    if not cells:
        cells = [cell("", "", *none)]
    sides = df.where(F.col("cohort").isin(a, b)).select((F.col("cohort") == F.lit(a)).alias("is_a"), cfg.slices().alias("_slices"), F.inline(F.array(*cells)))
    known = sides.where("text is not null or number is not null and not isnan(number)")
    return known.select("is_a", "kind", "field", "text", "number", F.explode("_slices").alias("slice")).groupBy(
        "slice", "kind", "field", "text", "number").agg(F.count_if("is_a").alias("o_a"), F.count_if(~F.col("is_a")).alias("o_b"))


def large_slices(found: DataFrame, cfg: Measurements) -> DataFrame:
    """Slices with enough rows in both cohorts, from the member counts."""
    least = cfg.min_n()
    return found.where(F.col("kind") == MEMBER).where((F.col("o_a") >= least) & (F.col("o_b") >= least)).select(
        "slice", F.col("o_a").alias("slice_n_a"), F.col("o_b").alias("slice_n_b"))


def contingency(df: DataFrame, cohorts: tuple[str, str], cfg: Measurements) -> DataFrame:
    """Cells of the 2 x k tables."""
    return cells_of(counts(df, cohorts, cfg, (CATEGORY,)))


def cells_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == CATEGORY).select(*TEST, F.col("text").alias("value"), "o_a", "o_b")


def chi_square(cells: DataFrame) -> DataFrame:
    """T1, T2 from cells: chi-square with Yates correction when there is one degree of freedom."""
    totals = cells.groupBy(*TEST).agg(
        F.sum("o_a").alias("n_a"), F.sum("o_b").alias("n_b"), F.count(F.lit(1)).alias("k"))
    usable = totals.where("k >= 2 and n_a > 0 and n_b > 0").withColumn("total", F.col("n_a") + F.col("n_b"))
    both = F.col("o_a") + F.col("o_b")
    e_a, e_b = both * F.col("n_a") / F.col("total"), both * F.col("n_b") / F.col("total")
    def part(o: Column, e: Column) -> Column:
        gap = F.abs(o - e)
        cut = F.when(F.col("k") == 2, F.least(F.lit(0.5), gap)).otherwise(0.0)
        return (gap - cut) * (gap - cut) / e
    summed = cells.join(usable, TEST).groupBy(*TEST, "n_a", "n_b", "k", "total").agg(
        F.sum(part(F.col("o_a"), e_a) + part(F.col("o_b"), e_b)).alias("statistic"),
        (F.min(F.least(e_a, e_b)) < 5).alias("low_expected"),
        F.count(F.lit(1)).alias("categories"))
    dof = F.col("k") - 1
    v = F.sqrt(F.col("statistic") / F.col("total"))
    return summed.select(
        *TEST, F.lit("chi-square").alias("test"), "statistic", dof.alias("dof"), v.alias("effect"),
        "n_a", "n_b", "low_expected")


def mann_whitney(df: DataFrame, cohorts: tuple[str, str], cfg: Measurements, min_n: int = 3) -> DataFrame:
    """U of cohort A, tie term, Cohen's d, medians, means, deviations."""
    return rank_tests(counts(df, cohorts, cfg, (NUMBER,)), min_n)


def rank_tests(found: DataFrame, min_n: int = 3) -> DataFrame:
    counted = found.where(F.col("kind") == NUMBER).select(
        *TEST, F.col("number").alias("value"), (F.col("o_a") + F.col("o_b")).alias("n"), F.col("o_a").alias("a"), F.col("o_b").alias("b"))
    table = R.ranked_counts(counted, TEST, "value", ["a", "b"])
    v, n, a, b = (F.col(c) for c in ("value", "n", "a", "b"))
    mean_a, mean_b = N.ratio(F.col("a_amount"), F.col("a_size")), N.ratio(F.col("b_amount"), F.col("b_size"))
    folded = table.groupBy(*TEST).agg(
        F.max("a_size").alias("n_a"), F.max("b_size").alias("n_b"),
        F.sum(a * (F.col("below") + (n + 1) / 2.0)).alias("rank_sum_a"),
        F.sum(n.cast("double") * n * n - n).alias("ties"),
        F.max(mean_a).alias("mean_a"), F.max(mean_b).alias("mean_b"),
        F.sum(a * (v - mean_a) * (v - mean_a)).alias("_ss_a"),
        F.sum(b * (v - mean_b) * (v - mean_b)).alias("_ss_b"),
        R.percentile_agg("value", 0.5, "a").alias("median_a"),
        R.percentile_agg("value", 0.5, "b").alias("median_b"),
    ).where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    var_a, var_b = F.col("_ss_a") / (n_a - 1), F.col("_ss_b") / (n_b - 1)
    return folded.select(
        *TEST, F.lit("mann-whitney-u").alias("test"),
        (F.col("rank_sum_a") - n_a * (n_a + 1) / 2.0).alias("statistic"),
        N.cohens_d(n_a, F.col("mean_a"), var_a, n_b, F.col("mean_b"), var_b).alias("effect"),
        "n_a", "n_b", "ties", "mean_a", "mean_b",
        F.sqrt(var_a).alias("std_a"), F.sqrt(var_b).alias("std_b"), "median_a", "median_b")


def proportions(df: DataFrame, cohorts: tuple[str, str], cfg: Measurements, min_n: int = 3) -> DataFrame:
    """Pooled z, Wilson intervals and Cohen's h. A null value counts as a miss."""
    return share_tests(counts(df, cohorts, cfg, (HIT,)), min_n)


def share_tests(found: DataFrame, min_n: int = 3) -> DataFrame:
    hit = F.col("text") == "true"
    sums = found.where(F.col("kind") == HIT).groupBy(*TEST).agg(
        F.sum("o_a").alias("n_a"), F.sum("o_b").alias("n_b"),
        F.sum(F.when(hit, F.col("o_a")).otherwise(0)).alias("x_a"), F.sum(F.when(hit, F.col("o_b")).otherwise(0)).alias("x_b"),
    ).where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    p_a, lo_a, hi_a = N.wilson(F.col("x_a"), F.col("n_a"))
    p_b, lo_b, hi_b = N.wilson(F.col("x_b"), F.col("n_b"))
    return sums.select(
        *TEST, F.lit("two-proportion-z").alias("test"),
        N.pooled_z(F.col("x_a"), F.col("n_a"), F.col("x_b"), F.col("n_b")).alias("statistic"),
        N.cohens_h(p_a, p_b).alias("effect"), "n_a", "n_b", "x_a", "x_b",
        p_a.alias("proportion_a"), lo_a.alias("ci_lower_a"), hi_a.alias("ci_upper_a"),
        p_b.alias("proportion_b"), lo_b.alias("ci_lower_b"), hi_b.alias("ci_upper_b"))


def run_tests(df: DataFrame, cohorts: tuple[str, str], cfg: Measurements = Measurements(), keep=write_stage) -> DataFrame:
    """The long table of all tests of all slices, with p-values, effects and themes.

    The counts and the finished tests (one row each) are stages: the input is
    read once, and the step-up correction reads rows that exist.
    """
    found = keep(counts(df, cohorts, cfg), "test-counts")
    parts = [
        chi_square(cells_of(found)).withColumn("p_value", PV.chi_square_p(F.col("statistic"), F.col("dof"))),
        rank_tests(found).withColumn("p_value", PV.u_p(F.col("statistic"), F.col("n_a"), F.col("n_b"), F.col("ties"))),
        share_tests(found).withColumn("p_value", PV.z_p(F.col("statistic"))),
    ]
    tests = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    kept = tests.join(large_slices(found, cfg).select("slice"), "slice")
    return keep(kept.withColumn("effect_size", F.abs("effect")).withColumn(
        "effect_label", N.effect_label(F.col("effect"))
    ).withColumn("significant_p05", F.col("p_value") < 0.05).withColumn("theme", cfg.theme()), "tests")


def adjust(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg over all rows.

    Works on distinct p-values in value ranges, so it holds for any number of
    tests. Equal p-values share the largest rank, which is what the cumulative
    minimum gives them.
    """
    base = tests.withColumn("_all", F.lit(0))
    table = R.ranked(base, ["_all"], p, keep_block=True)
    raw = F.col(p) * F.col("size") / (F.col("below") + F.col("n"))
    stepped = S.ordered(
        table.withColumn("_raw", raw), ["_all"], [p], F.col("_block"), p_adjusted=S.lowest_from(F.col("_raw")))
    found = stepped.select(
        F.col(p).alias("_p"), F.col("size").alias("_m"), F.least(F.col("p_adjusted"), F.lit(1.0)).alias("p_adjusted"))
    return tests.join(found, F.col(p).cast("double") == F.col("_p"), "left").drop("_p").select(
        *tests.columns, "p_adjusted",
        (F.col(p) < F.lit(alpha) / F.col("_m")).alias("bonferroni_significant"),
        (F.col("p_adjusted") < alpha).alias("fdr_significant"))


def shared_projects(df: DataFrame, cohorts: tuple[str, str], project: str = "project_path") -> DataFrame:
    """Projects present in both cohorts, from one aggregate instead of two scans."""
    a, b = cohorts
    return df.where(F.col(project) != "").groupBy(project).agg(
        F.bool_or(F.col("cohort") == a).alias("_a"), F.bool_or(F.col("cohort") == b).alias("_b")
    ).where("_a and _b").select(project)


def restricted(df: DataFrame, cohorts: tuple[str, str], project: str = "project_path") -> DataFrame:
    """Rows of the shared projects."""
    return df.join(shared_projects(df, cohorts, project), project, "left_semi")


def sensitivity(full: DataFrame, narrow: DataFrame) -> DataFrame:
    """Proportion tests of the full and the restricted run side by side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where("test = 'two-proportion-z'").select(
            *TEST, (F.col("proportion_a") - F.col("proportion_b")).alias(f"{name}_diff"),
            F.col("p_value").alias(f"{name}_p"), F.col("significant_p05").alias(f"{name}_significant"))
    both = side(full, "full").join(side(narrow, "restricted"), TEST)
    return both.withColumn("agreement", agreement(
        F.col("full_diff"), F.col("restricted_diff"), F.col("full_significant"), F.col("restricted_significant")))


def agreement(full_diff: Column, narrow_diff: Column, full_sig: Column, narrow_sig: Column) -> Column:
    same = F.when((full_diff != 0) & (narrow_diff != 0), (full_diff > 0) == (narrow_diff > 0)).otherwise(True)
    return (
        F.when((full_sig == narrow_sig) & same, "agree")
        .when(same & ~(full_sig & narrow_sig), "weak")
        .otherwise("DIVERGE"))


def persisting(full: DataFrame, narrow: DataFrame) -> DataFrame:
    """Bonferroni survivors of the full run and whether they survive in the restricted one."""
    kept = narrow.select(*TEST, "test", F.col("bonferroni_significant").alias("persists"),
                         F.col("p_value").alias("restricted_p"))
    return full.where("bonferroni_significant").join(kept, [*TEST, "test"], "left").select(
        *TEST, "test", "p_value", "restricted_p", F.coalesce("persists", F.lit(False)).alias("persists"))


def measure_by_slice(tests: DataFrame, field: str, prefix: str) -> DataFrame:
    """Medians and means of one field over the slices of one cut."""
    return tests.where((F.col("test") == "mann-whitney-u") & (F.col("field") == field)
                       & F.col("slice").startswith(prefix)).select(
        F.substring_index("slice", ":", -1).alias("value"), "median_a", "median_b", "mean_a", "mean_b", "n_a", "n_b")


def quotas(sizes: DataFrame, stratum: str, n: Column) -> DataFrame:
    """sizes (stratum, size) with ``quota``: n seats in all, or all rows if there are fewer.

    A stratum gets the whole part of its share of n, at least one, and the seats
    left over go to the largest remainders. Where the ones alone overdraw n,
    every stratum gets one and the others go by largest remainder over what the
    strata have left. With fewer seats than strata the largest strata get one.
    """
    whole = sizes.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("strata")).select(F.struct("total", "strata")).scalar()
    known = sizes.withColumn("_all", whole).withColumn("_seats", F.least(n, F.col("_all.total")))

    def shares(seats: Column, size: Column, total: Column) -> tuple[Column, Column]:
        """Whole part and remainder of seats * size / total, exact at every size."""
        product, some = seats.cast("decimal(38,0)") * size, F.greatest(total, F.lit(1))
        part = F.when(seats > 0, F.floor(product / some)).otherwise(0).cast("long")
        return part, ((product - part * some) / some).cast("double")

    part, over = shares(F.col("_seats"), F.col("size"), F.col("_all.total"))
    rest, left = F.col("_seats") - F.col("_all.strata"), F.col("_all.total") - F.col("_all.strata")
    tight_part, tight_over = shares(rest, F.col("size") - 1, left)
    both = known.withColumns({"_part": F.greatest(part, F.lit(1)), "_over": F.when(part > 0, over).otherwise(0.0),
                              "_tight": 1 + tight_part, "_tight_over": tight_over})
    sums = both.agg(F.struct(F.sum("_part").alias("part"), F.sum("_tight").alias("tight"))).scalar()
    both = both.withColumn("_sums", sums)
    loose, enough = F.col("_sums.part") <= F.col("_seats"), rest >= 0
    score = F.when(loose, F.col("_over")).when(enough, F.col("_tight_over")).otherwise(F.col("size") / F.col("_all.total"))
    given = F.when(loose, F.col("_part")).when(enough, F.col("_tight")).otherwise(0)
    spare = F.col("_seats") - F.when(loose, F.col("_sums.part")).when(enough, F.col("_sums.tight")).otherwise(0)
    placed = S.ordered(both.select(stratum, "size", given.alias("_given"), spare.alias("_spare"), (-score).alias("_score"),
                                   F.col(stratum).isNull().alias("_null")),
                       [], ["_score", "_null", stratum], F.floor(F.col("_score") * 256), _place=S.position())
    return placed.select(stratum, "size", (F.col("_given") + (F.col("_place") <= F.col("_spare")).cast("long")).alias("quota"))


def stratified_sample(df: DataFrame, stratum: str, ident: str, n: int | None = None, share: float | None = None, seed: int = 42,
                      eligible: Column | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Exactly n rows (or a share of them), by stratum, at least one of each; a null stratum is one of them.

    Only rows for which ``eligible`` holds and whose id is not in ``taken`` take
    part. A stratum gives the rows whose MD5 of (id, seed) is smallest. Hashes
    are counted by their first three digits; only the rows of the one block in
    which a stratum reaches its quota are ever sorted.
    """
    pool = df if eligible is None else df.where(eligible)
    if taken is not None:
        pool = pool.join(taken.select(F.col(ident)).distinct(), ident, "left_anti")
    pool = pool.withColumn("_h", F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed))))).withColumn("_block", F.substring("_h", 1, 3))
    counts = pool.groupBy(stratum, "_block").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(stratum).agg(F.sum("_n").alias("size"))
    seats = F.lit(n).cast("long") if n is not None else F.ceil(F.lit(share) * sizes.agg(F.sum("size")).scalar()).cast("long")
    before = Window.partitionBy(stratum).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows of a stratum at most
    cut = S.join_keys(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), quotas(sizes, stratum, seats), [stratum])
    cut = cut.where("_before < quota").select(stratum, "_block", (F.col("quota") - F.col("_before")).alias("_need"), "_n")
    kept = S.join_keys(pool, cut, [stratum, "_block"])
    within = Window.partitionBy(stratum, "_block").orderBy("_h", ident)
    last = kept.where("_need < _n").withColumn("_place", F.row_number().over(within)).where("_place <= _need")
    return kept.where("_need >= _n").select(*df.columns).unionByName(last.select(*df.columns))


def shuffled_sample(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """Plain seeded sample of n rows: a distributed top-n by hash."""
    return df.orderBy(F.xxhash64(F.col(ident), F.lit(seed)), F.col(ident)).limit(n)
