"""Named report tables (survey section 2.13, A41).

``VIEWS[name](results)`` returns the numbers of one report table. Shares come
with their Wilson interval, differences are B against A.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import numbers as N
from taskloom.functions import patterns as P
from taskloom.operators import behavior as BH
from taskloom.operators import dataset as D
from taskloom.operators import edits as E
from taskloom.operators import ranks as R
from taskloom.operators import scan as S
from taskloom.operators import timing as TM
from taskloom.operators import tokens as TOK
from taskloom.operators import abtests as AB
from taskloom.plans.pipeline import Results

VIEWS: dict[str, Callable[[Results], DataFrame]] = {}


def view(fn: Callable[[Results], DataFrame]) -> Callable[[Results], DataFrame]:
    VIEWS[f"v_{fn.__name__}"] = fn
    return fn


# --- helpers -----------------------------------------------------------------
def ab(df: DataFrame, key: list[str], values: list[str], cohorts: tuple[str, str]) -> DataFrame:
    """Columns ``<value>_a`` and ``<value>_b`` per key, one aggregate."""
    a, b = cohorts
    return df.groupBy(*key).agg(*[
        F.max(F.when(F.col("cohort") == c, F.col(v))).alias(f"{v}_{side}") for v in values for side, c in (("a", a), ("b", b))])


def with_share(df: DataFrame, hits: str, total: str) -> DataFrame:
    p, lo, hi = N.wilson(F.col(hits), F.col(total))
    return df.select("*", (p * 100).alias("pct"), (lo * 100).alias("ci_lower"), (hi * 100).alias("ci_upper"))


def shares(df: DataFrame, key: list[str], hit: Column, cohorts: tuple[str, str]) -> DataFrame:
    """Share of rows with ``hit`` per key and cohort, its interval, and the difference in points."""
    counts = df.groupBy("cohort", *key).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    wide = ab(with_share(counts, "hits", "n"), key, ["hits", "n", "pct", "ci_lower", "ci_upper"], cohorts)
    delta = F.col("pct_b") - F.col("pct_a")
    return wide.withColumn("delta_pp", delta).withColumn("direction", N.percentage_points_tie(delta))


def category_shares(df: DataFrame, value: str, cohorts: tuple[str, str]) -> DataFrame:
    """Share of every category, against all rows of the cohort that have one."""
    some = df.where(F.col(value).isNotNull())
    counts = some.groupBy("cohort", value).agg(F.count(F.lit(1)).alias("hits"))
    totals = some.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    wide = ab(with_share(counts.join(totals, "cohort"), "hits", "n"), [value],
              ["hits", "n", "pct", "ci_lower", "ci_upper"], cohorts)
    return wide.withColumn("delta_pp", F.coalesce("pct_b", F.lit(0.0)) - F.coalesce("pct_a", F.lit(0.0)))


def ordered_levels(df: DataFrame, column: str, order: list[str] = P.COMPLEXITY_ORDER) -> DataFrame:
    """Rows in the fixed order of a category."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(rank > 0, rank).otherwise(len(order) + 1), column)


def complexity(r: Results) -> Column:
    return F.col("classification.complexity")


def tasks_of(r: Results) -> DataFrame:
    return r.tasks.withColumn("complexity", complexity(r)).withColumn("type", F.col("classification.type"))


def token_stats(r: Results, level: str) -> DataFrame:
    return TOK.token_stats(tasks_of(r), ["cohort", level])


# --- dataset -----------------------------------------------------------------
@view
def dataset_composition(r: Results) -> DataFrame:
    s = D.session_overview(r.sessions)
    t = D.task_overview(r.tasks).select(F.col("cohort").alias("_c"), "tasks")
    both = s.join(t, s.cohort.eqNullSafe(t._c), "left").drop("_c")
    shared = AB.shared_projects(r.sessions, r.cohorts).select(F.count(F.lit(1))).scalar()
    return both.withColumn("tasks_per_session", N.ratio(F.col("tasks"), F.col("sessions"))).withColumn(
        "shared_projects", shared)


@view
def dataset_task_mix(r: Results) -> DataFrame:
    t = tasks_of(r)
    levels = t.select("cohort", F.inline(F.array(
        F.struct(F.lit("type").alias("kind"), F.col("type").alias("value")),
        F.struct(F.lit("complexity").alias("kind"), F.col("complexity").alias("value")),
        F.struct(F.lit("size").alias("kind"), F.when(
            F.col("complexity").isin("moderate", "complex", "major"), "moderate+").otherwise("below").alias("value")))))
    return ab(D.distribution(levels, ["cohort", "kind"], "value"), ["kind", "value"], ["count", "pct"], r.cohorts)


@view
def dataset_volume(r: Results) -> DataFrame:
    sums = r.tasks.rollup("cohort").agg(*[F.sum(c).alias(c) for c in (
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "estimated_cost",
        "total_lines_added", "total_lines_removed", "total_files_touched")])
    every = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return sums.withColumn("cache_read_pct", N.percent(F.col("cache_read_tokens"), every))


@view
def complexity_distribution(r: Results) -> DataFrame:
    return ordered_levels(category_shares(tasks_of(r), "complexity", r.cohorts), "complexity")


@view
def resources(r: Results) -> DataFrame:
    means = r.tasks.groupBy("cohort").agg(
        F.avg("tool_count").alias("tools"), F.avg("total_files_touched").alias("files"),
        F.avg(F.col("total_lines_added") + F.col("total_lines_removed")).alias("lines"))
    long = means.select("cohort", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("mean")) for m in ("tools", "files", "lines")])))
    wide = ab(long, ["measure"], ["mean"], r.cohorts)
    return wide.select("*", *[c.alias(n) for n, c in N.deltas(F.col("mean_a"), F.col("mean_b")).items()])


@view
def scope_by_complexity(r: Results) -> DataFrame:
    per = D.scope_by(tasks_of(r), ["cohort", "complexity"])
    return ordered_levels(ab(per, ["complexity"], ["count", "avg_files_touched", "avg_lines_added", "avg_lines_removed"],
                             r.cohorts), "complexity")


@view
def duration_percentiles(r: Results) -> DataFrame:
    return R.quantiles(r.tasks.where("duration_seconds > 0"), ["cohort"], "duration_seconds", nearest=True)


@view
def duration_distribution(r: Results) -> DataFrame:
    return ab(TM.duration_buckets(r.tasks, ["cohort"], "duration_seconds"), ["bucket_order", "bucket"],
              ["count", "pct"], r.cohorts).orderBy("bucket_order")


# --- edits -------------------------------------------------------------------
@view
def edit_overview(r: Results) -> DataFrame:
    return E.edit_summary(r.edit_metrics, r.overlaps, ["cohort"])


@view
def edit_rewrite(r: Results) -> DataFrame:
    s = E.edit_summary(r.edit_metrics, r.overlaps, ["cohort"]).withColumn("ops", F.col("edits") + F.col("writes"))
    kinds = [c for c in s.columns if c.startswith("class_")]
    return with_share(s, "overlaps", "ops").select(
        "cohort", "overlaps", "ops", "pct", "ci_lower", "ci_upper",
        *[N.percent(F.col(c), F.col("overlaps")).alias(f"{c}_pct") for c in kinds])


def _binned(r: Results) -> DataFrame:
    return r.edit_metrics.join(tasks_of(r).select("task_id", "complexity", "duration_seconds"), "task_id")


@view
def iterative_refinement(r: Results) -> DataFrame:
    """A17 by complexity and by duration tercile of each cohort."""
    m = _binned(r)
    cuts = R.terciles(m, ["cohort"], "duration_seconds")
    tagged = m.join(cuts, "cohort", "left").select("*", F.explode(F.array(
        F.struct(F.lit("complexity").alias("by"), F.col("complexity").alias("bin")),
        F.struct(F.lit("duration").alias("by"), E.tercile_of(
            F.col("duration_seconds"), F.coalesce("t1", F.lit(0.0)), F.coalesce("t2", F.lit(0.0))).alias("bin")))).alias("x"))
    rates = E.bin_rates(tagged.select("*", "x.*"), ["cohort", "by", "bin"])
    return ab(rates, ["by", "bin"], ["iterative_refinement_rate", "n"], r.cohorts)


def _rate(r: Results, rate: str) -> DataFrame:
    per = E.bin_rates(_binned(r), ["cohort", "complexity"])
    return ordered_levels(ab(per, ["complexity"], [rate, "n"], r.cohorts), "complexity")


@view
def iterative_by_complexity(r: Results) -> DataFrame:
    return _rate(r, "iterative_refinement_rate")


@view
def self_correction_by_complexity(r: Results) -> DataFrame:
    return _rate(r, "self_correction_rate")


@view
def triage_top(r: Results) -> DataFrame:
    """O1: the ten tasks with most rework of each cohort."""
    return TM.top_per_group(r.edit_metrics.where("triage_score > 0"), ["cohort"],
                            [F.desc("triage_score"), F.asc("task_id")], 10)


# --- outcomes ------------------------------------------------------------------
@view
def satisfaction_tests(r: Results) -> DataFrame:
    wanted = ["alignment_score", "satisfaction_rate", "dissatisfaction_rate", "complete_rate", "failed_rate", "task_completion"]
    return r.tests.where((F.col("slice") == "overall") & F.col("field").isin(wanted)).select(
        "field", "test", "statistic", "p_value", "effect", "effect_label", "bonferroni_significant",
        "n_a", "n_b", "median_a", "median_b", "mean_a", "mean_b", "std_a", "std_b", "proportion_a", "proportion_b")


@view
def sentiment(r: Results) -> DataFrame:
    return category_shares(r.annotated, "normalized_user_sentiment", r.cohorts)


@view
def completion(r: Results) -> DataFrame:
    """Completion wording merged by its prefix."""
    merged = r.annotated.withColumn("completion", F.trim(F.substring_index("task_completion", " - ", 1)))
    return category_shares(merged, "completion", r.cohorts)


def _quality(r: Results) -> DataFrame:
    notes = r.annotated.select("task_id", "alignment_score", "normalized_user_sentiment", "task_completion", "tools_per_file")
    tasks = r.tasks.withColumn("start_s", S.epoch_seconds("start_ts")).join(notes, "task_id", "left")
    return TM.task_rank_in_session(tasks, ["cohort", "session_id"], ["msg_index_start"], S.index_chunk("msg_index_start"))


@view
def warmup(r: Results) -> DataFrame:
    return TM.warmup(_quality(r), ["cohort"])


@view
def session_length(r: Results) -> DataFrame:
    return TM.session_length(_quality(r), ["cohort"])


@view
def effort(r: Results) -> DataFrame:
    per_task = TM.frontload(r.calls, ["cohort", "session_id", "task_n"], ["msg_index", "pos"], S.index_chunk("msg_index"))
    return TM.effort_summary(per_task, ["cohort"])


# --- compaction ------------------------------------------------------------------
def _session_spans(r: Results) -> DataFrame:
    return r.all_tasks.groupBy("cohort", "session_id").agg(
        F.max("msg_index_end").alias("last_index"), F.sum("duration_seconds").alias("duration_seconds"))


@view
def compaction_overview(r: Results) -> DataFrame:
    p = BH.compaction_profile(r.compactions, _session_spans(r), ["cohort"])
    return p.withColumn("auto_pct", N.percent(F.col("auto_events"), F.col("total_events")))


def _did(r: Results) -> DataFrame:
    notes = r.annotated.select("task_id", "alignment_score", "normalized_user_sentiment", "task_completion")
    edits = r.edit_metrics.select("task_id", "edit_count", "user_corrections")
    tasks = r.tasks.select("cohort", "session_id", "task_id", "task_n", S.epoch_seconds("start_ts").alias("start_s")).join(
        notes, "task_id", "left").join(edits, "task_id", "left")
    first = r.compactions.groupBy("session_id").agg(S.epoch_seconds_of(F.min("ts")).alias("event_s"))
    spans = _session_spans(r)
    place = TM.position_in_session(r.compactions, spans).join(spans.select("cohort", "session_id"), "session_id")
    median = R.quantiles(place, ["cohort"], "position_pct", {"median_pct": 0.5})
    split = BH.split_phases(tasks, first, median, ["cohort"], ["start_s", "task_n"], S.time_chunk(F.col("start_s"), S.HOUR * 24))
    return BH.difference_in_differences(BH.outcome_metrics(split, ["cohort", "arm", "phase"]), ["cohort"])


@view
def compaction_outcomes(r: Results) -> DataFrame:
    return _did(r).select("cohort", "measure", "delta", "control_delta", "effect")


@view
def compaction_impact(r: Results) -> DataFrame:
    return _did(r).where(F.col("cohort") == r.cohorts[0])


# --- planning and agents -----------------------------------------------------------
def _planning(r: Results) -> DataFrame:
    notes = r.annotated.where("has_annotation").select("task_id", F.col("alignment_score").alias("score"))
    t = tasks_of(r).withColumn("planned", F.col("used_planning")).join(notes, "task_id", "left")
    return BH.planning_crosstab(t, ["cohort"])


@view
def planning_alignment(r: Results) -> DataFrame:
    return ordered_levels(_planning(r).select(
        "cohort", "complexity", "score_planned", "n_scored_planned", "score_unplanned", "n_scored_unplanned", "score_delta"), "complexity")


@view
def planning_adoption(r: Results) -> DataFrame:
    return _planning(r).where("complexity is null").select("cohort", "planning_rate_pct", "planned", "n")


@view
def planning_by_complexity(r: Results) -> DataFrame:
    per = _planning(r).where("complexity is not null")
    return ordered_levels(ab(per, ["complexity"], ["planning_rate_pct", "planned", "n"], r.cohorts), "complexity")


@view
def behavior_adoption(r: Results) -> DataFrame:
    b = BH.behavior(r.tasks, ["cohort"])
    long = b.select("cohort", F.inline(F.array(
        F.struct(F.lit("planning").alias("measure"), F.col("tasks_with_planning").alias("hits"), F.col("total_tasks").alias("n")),
        F.struct(F.lit("subagents").alias("measure"), F.col("tasks_with_subagents").alias("hits"), F.col("total_tasks").alias("n")),
        F.struct(F.lit("autonomous agents").alias("measure"), F.col("subagent_autonomous").alias("hits"),
                 F.col("total_subagent_calls").alias("n")))))
    return ab(with_share(long, "hits", "n"), ["measure"], ["hits", "n", "pct", "ci_lower", "ci_upper"], r.cohorts)


@view
def subagent_types(r: Results) -> DataFrame:
    return category_shares(r.calls.where("subagent_type is not null"), "subagent_type", r.cohorts)


# --- tokens --------------------------------------------------------------------------
@view
def thinking_calibration(r: Results) -> DataFrame:
    return ordered_levels(shares(tasks_of(r), ["complexity"], F.col("thinking_blocks") > 0, r.cohorts), "complexity")


def _ratio_view(r: Results, level: str, value: str, order: Column | None = None) -> DataFrame:
    wide = ab(token_stats(r, level), [level], [value, "count"], r.cohorts)
    out = wide.select("*", *[c.alias(n) for n, c in N.deltas(F.col(f"{value}_a"), F.col(f"{value}_b")).items()])
    return out.orderBy(F.desc(F.coalesce(f"{value}_b", F.lit(0.0))), level) if order is None else out


@view
def thinking_depth_by_type(r: Results) -> DataFrame:
    return _ratio_view(r, "type", "avg_thinking_chars_when_used")


def _interval_view(r: Results, level: str, value: str, mean: Column) -> DataFrame:
    """Mean per group with its bootstrap interval; O9: ordered by the lower end for B."""
    from taskloom.operators import bootstrap as B

    t = tasks_of(r).withColumn("_v", mean)
    ci = B.mean_interval(t, ["cohort", level], "_v", "task_id", 2000, by_index=True).withColumnRenamed("mean", value)
    wide = ab(ci, [level], [value, "ci_lower", "ci_upper", "n"], r.cohorts)
    out = wide.select("*", *[c.alias(n) for n, c in N.deltas(F.col(f"{value}_a"), F.col(f"{value}_b")).items()])
    return out.orderBy(F.desc(F.coalesce("ci_lower_b", f"{value}_b")), level)


@view
def verbosity_by_type(r: Results) -> DataFrame:
    """Known types that both cohorts have output for."""
    both = _interval_view(r, "type", "avg_output_tokens", F.col("total_output_tokens").cast("double"))
    return both.where("type <> 'unknown' and avg_output_tokens_a > 0 and avg_output_tokens_b > 0")


@view
def cost_by_complexity(r: Results) -> DataFrame:
    return ordered_levels(_interval_view(r, "complexity", "avg_cost_usd", F.col("estimated_cost")), "complexity")


@view
def per_request_output(r: Results) -> DataFrame:
    per = N.ratio0(F.col("total_output_tokens"), F.col("request_count"))
    return ordered_levels(_interval_view(r, "complexity", "output_per_request", per), "complexity")


@view
def cache_efficiency(r: Results) -> DataFrame:
    """Cache writes per task and share of reads, per complexity and overall."""
    levels = tasks_of(r).select("cohort", "cache_read_tokens", "cache_write_tokens", F.explode(
        F.array("complexity", F.lit("overall"))).alias("complexity"))
    per = levels.groupBy("cohort", "complexity").agg(
        F.avg("cache_write_tokens").alias("writes_per_task"),
        N.percent(F.sum("cache_read_tokens"), F.sum("cache_read_tokens") + F.sum("cache_write_tokens")).alias("read_pct"))
    wide = ab(per, ["complexity"], ["writes_per_task", "read_pct"], r.cohorts)
    return ordered_levels(wide.withColumn("ratio", N.ratio(F.col("writes_per_task_b"), F.col("writes_per_task_a"))), "complexity")


@view
def idle_sensitivity(r: Results) -> DataFrame:
    timed = r.tasks.select("cohort", "session_id", "task_n", "duration_seconds", "estimated_cost",
                           S.epoch_seconds("start_ts").alias("start_s"), S.epoch_seconds("end_ts").alias("end_s"))
    gaps = TM.task_gaps(timed, ["cohort", "session_id"], "task_n")
    return ab(TM.active_time_cost(gaps, ["cohort"], ["session_id"]), ["threshold_min"],
              ["total_active_hours", "cost_per_active_hour"], r.cohorts).orderBy("threshold_min")


# --- findings --------------------------------------------------------------------------
@view
def findings_summary(r: Results) -> DataFrame:
    """Overall findings: the significant ones first, then the others."""
    overall = r.findings.where("cross_cut = 'overall'")
    return overall.orderBy(F.desc(F.coalesce("fdr_significant", F.lit(False))), "rank")


@view
def findings_by_theme(r: Results, theme: str | None = None) -> DataFrame:
    """Findings of one theme, or of all themes after each other."""
    found = r.findings if theme is None else r.findings.where(F.col("theme") == theme)
    return found.orderBy(F.col("theme").asc_nulls_last(), "rank")


@view
def sensitivity(r: Results) -> DataFrame:
    overall = F.col("slice") == "overall"
    return AB.persisting(r.tests.where(overall), r.restricted_tests.where(overall))


@view
def stat_tests(r: Results) -> DataFrame:
    from taskloom.operators.findings import direction

    return r.tests.select(
        "slice", "test", "field", "p_value", "effect_size", "effect_label",
        F.when(F.col("bonferroni_significant"), "**").when(F.col("significant_p05"), "*").otherwise("").alias("mark"),
        direction(r.cohorts).alias("direction")).orderBy("slice", "test", "field")
