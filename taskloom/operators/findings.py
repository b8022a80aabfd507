"""Ranked findings from the test table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def direction(cohorts: tuple[str, str]) -> Column:
    a, b = cohorts
    def side(x: Column, y: Column) -> Column:
        return F.when(y > x, f"{b} higher").when(x > y, f"{a} higher").when(x == y, "equal")
    return (
        F.when(F.col("test") == "mann-whitney-u", side(F.col("median_a"), F.col("median_b")))
        .when(F.col("test") == "two-proportion-z", side(F.col("proportion_a"), F.col("proportion_b")))
        .when(F.col("test") == "chi-square", "distributions differ"))


def _shown(name: str) -> str:
    return name.replace("-", " ").title()


def narrative(cohorts: tuple[str, str]) -> Column:
    """One fixed sentence per test kind."""
    a, b = (_shown(c) for c in cohorts)
    field = F.replace("field", F.lit("_"), F.lit(" "))
    d = F.format_string("d=%.2f", F.abs("effect"))
    h = F.format_string("h=%.2f", F.abs("effect"))
    med_a, med_b, p_a, p_b = (F.col(c) for c in ("median_a", "median_b", "proportion_a", "proportion_b"))
    none = F.concat(F.lit("No significant difference in "), field)
    def median(name: str, x: Column, y: Column) -> Column:
        return F.concat(F.lit(f"{name} has higher "), field,
                        F.format_string(" (median %.1f vs %.1f, ", x, y), F.coalesce(d, F.lit("")), F.lit(")"))
    def share(first: str, x: Column, second: str, y: Column) -> Column:
        return F.concat(field, F.lit(f": {first} "), F.format_string("%.1f%%", x * 100), F.lit(f" vs {second} "),
                        F.format_string("%.1f%% (", y * 100), h, F.lit(")"))
    return (
        F.when(F.col("test") == "mann-whitney-u",
               F.when(med_b > med_a, median(b, med_b, med_a)).when(med_a > med_b, median(a, med_a, med_b)).otherwise(none))
        .when(F.col("test") == "two-proportion-z",
              F.when(p_b > p_a, share(b, p_b, a, p_a)).when(p_a > p_b, share(a, p_a, b, p_b)).otherwise(none))
        .otherwise(F.concat(field, F.format_string(" distributions differ (V=%.2f, ", F.col("effect")),
                            F.col("effect_label"), F.lit(")"))))


def findings(tests: DataFrame, cohorts: tuple[str, str]) -> DataFrame:
    """FDR-significant first, then by effect size.

    One row per test, so the ranking window holds slices x fields rows, a number
    set by the measurement configuration and not by the data.
    """
    by_rank = Window.partitionBy("_all").orderBy(
        (~F.col("fdr_significant")).asc(), F.coalesce("effect_size", F.lit(0.0)).desc(), "slice", "field", "test")
    return tests.withColumn("_all", F.lit(0)).select(
        F.row_number().over(by_rank).alias("rank"), "field", F.col("test").alias("test_type"),
        F.col("slice").alias("cross_cut"), "theme", "p_value", "p_adjusted", "fdr_significant",
        "bonferroni_significant", "effect_size", "effect_label",
        direction(cohorts).alias("direction"), narrative(cohorts).alias("narrative"),
        F.struct(
            F.struct(F.col("median_a").alias("median"), F.col("mean_a").alias("mean"),
                     F.col("proportion_a").alias("proportion"), F.col("x_a").alias("count"), F.col("n_a").alias("n")).alias("a"),
            F.struct(F.col("median_b").alias("median"), F.col("mean_b").alias("mean"),
                     F.col("proportion_b").alias("proportion"), F.col("x_b").alias("count"), F.col("n_b").alias("n")).alias("b"),
        ).alias("values"))


def by_theme(found: DataFrame) -> DataFrame:
    """Significant and other findings per theme with the strongest effect."""
    return _grouped(found, F.coalesce("theme", F.lit("uncategorized")).alias("theme"), True)


def by_cross_cut(found: DataFrame) -> DataFrame:
    """T19."""
    return _grouped(found, F.col("cross_cut"), False)


def _grouped(found: DataFrame, key: Column, strongest: bool) -> DataFrame:
    sig = F.col("fdr_significant")
    ranks = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(c, F.col("rank")))))
    extra = [F.max(F.coalesce("effect_size", F.lit(0.0))).alias("strongest_effect")] if strongest else []
    return found.groupBy(key).agg(
        F.count_if(sig).alias("significant"), F.count_if(~sig).alias("non_significant"),
        ranks(sig).alias("significant_ranks"), *extra)


def condensed(tests: DataFrame) -> DataFrame:
    """Significant tests listed, the others counted per section."""
    section = F.substring_index("slice", ":", 1)
    return tests.groupBy(section.alias("section")).agg(
        F.count_if("significant_p05").alias("significant"), F.count_if(~F.col("significant_p05")).alias("not_significant"),
        F.array_sort(F.array_compact(F.collect_list(F.when(
            F.col("significant_p05"), F.concat_ws(" ", "slice", "test", "field"))))).alias("listed"))
