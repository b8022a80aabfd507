"""Agents, planning and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import classify as C
from taskloom.functions.numbers import mean0, percent, ratio, ratio0
from taskloom.operators import ranks as R
from taskloom.operators import scan as S


def behavior(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counters per cohort."""
    agents, bg = F.col("subagent_count"), F.col("run_in_background_count")
    used, planned = F.col("used_subagents"), F.col("used_planning")
    asked = C.wants_agents(F.col("user_prompt"))
    planned_by_user = C.wants_planning(F.col("user_prompt"))
    directive = C.agent_directive(F.col("user_prompt"))
    gp = F.col("general_purpose_agents")
    def total(cond: Column, value: Column) -> Column:
        return F.sum(F.when(cond, value).otherwise(0))
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tasks"), F.countDistinct("session_id").alias("total_sessions"),
        F.count_if(used).alias("tasks_with_subagents"), total(used, agents).alias("total_subagent_calls"),
        total(used, bg).alias("background_tasks"), total(used, agents - bg).alias("foreground_tasks"),
        total(used, gp).alias("gp_total"),
        total(used & asked, agents).alias("subagent_user_requested"),
        total(used & ~asked, agents).alias("subagent_autonomous"),
        total(used & asked, gp).alias("gp_user_requested"), total(used & ~asked, gp).alias("gp_autonomous"),
        F.count_if(planned).alias("tasks_with_planning"),
        F.count_if(planned & planned_by_user).alias("planning_user_requested"),
        F.count_if(planned & ~planned_by_user).alias("planning_autonomous"),
        F.sum("parallel_tool_messages").alias("messages_with_parallel"),
        F.sum("messages_with_tools").alias("messages_with_tools"),
        F.count_if(used & (directive == "parallel")).alias("parallel_directive_tasks"),
        F.count_if(used & (directive == "use_agents")).alias("use_agents_directive_tasks"))


def subagent_types(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls per agent type."""
    return calls.where("subagent_type is not null").groupBy(*keys, "subagent_type").agg(
        F.count(F.lit(1)).alias("calls"))


def directive_compliance(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks, agents and background runs per directive of the prompt."""
    return tasks.where("used_subagents").withColumn("directive", C.agent_directive(F.col("user_prompt"))).where(
        "directive is not null").groupBy(*keys, "directive").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("subagent_count").alias("agents"),
        F.sum("run_in_background_count").alias("background"))


def subagent_outcomes(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome by use of agents; ``has_subagent`` marks the tasks."""
    s = F.col("normalized_user_sentiment")
    bad = s.isin("dissatisfied", "frustrated")
    done = F.trim(F.substring_index("task_completion", " - ", 1))
    return annotated.groupBy(*keys, "has_subagent").agg(
        F.count_if(s == "satisfied").alias("satisfied"), F.count_if(bad).alias("dissatisfied"),
        F.count_if((s != "satisfied") & ~bad).alias("neutral"), F.count(F.lit(1)).alias("total"),
        mean0(F.col("alignment_score")).alias("avg_alignment"),
        *[F.count_if(done == c).alias(c) for c in ("complete", "partial", "interrupted", "failed")])


def planning_crosstab(tasks: DataFrame, keys: list[str], level: str = "complexity") -> DataFrame:
    """Per complexity planned and unplanned counts, rate, mean score and its difference.

    ``planned`` and ``score`` are columns of the input; the row with a null
    level holds the whole cohort.
    """
    p = F.col("planned")
    score = F.col("score")
    tagged = tasks.select(*keys, p.alias("planned"), score.alias("score"),
                          F.explode(F.array(F.col(level), F.lit(None).cast("string"))).alias(level))
    n, n_p = F.count(F.lit(1)), F.count_if(p)
    return tagged.groupBy(*keys, level).agg(
        n.alias("n"), n_p.alias("planned"), (n - n_p).alias("unplanned"), percent(n_p, n).alias("planning_rate_pct"),
        F.avg(F.when(p, score)).alias("score_planned"), F.avg(F.when(~p, score)).alias("score_unplanned"),
        (F.avg(F.when(p, score)) - F.avg(F.when(~p, score))).alias("score_delta"),
        F.count(F.when(p, score)).alias("n_scored_planned"), F.count(F.when(~p, score)).alias("n_scored_unplanned"),
        percent(F.count(score), n).alias("coverage_pct"))


# --- compaction --------------------------------------------------------------
def compaction_profile(events: DataFrame, session_tasks: DataFrame, keys: list[str]) -> DataFrame:
    """``events``: session_id, trigger, pre_tokens, msg_index. ``session_tasks``: keys, session_id,
    last_index, duration_seconds per session."""
    per_session = events.join(session_tasks.select("session_id", "last_index"), "session_id").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("trigger") == "auto").alias("auto_events"),
        F.sum(F.when(F.col("pre_tokens") > 0, F.col("pre_tokens"))).alias("pre_sum"),
        F.count_if(F.col("pre_tokens") > 0).alias("pre_n"),
        F.sum(ratio(F.col("msg_index") * 100.0, F.col("last_index"))).alias("pos_sum"),
        F.count_if(F.col("last_index") > 0).alias("pos_n"))
    j = session_tasks.join(per_session, "session_id", "left")
    has = F.col("events") > 0
    hours = F.sum(F.when(has, F.col("duration_seconds"))) / 3600
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count_if(has).alias("sessions_with_events"),
        percent(F.count_if(has), F.count(F.lit(1))).alias("event_rate_pct"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("auto_events"), F.lit(0)).alias("auto_events"),
        ratio0(F.sum("events"), F.count_if(has)).alias("events_per_session"),
        ratio0(F.sum("pre_sum"), F.sum("pre_n")).alias("avg_pre_tokens"),
        ratio0(F.sum("pos_sum"), F.sum("pos_n")).alias("avg_position_pct"),
        ratio0(F.sum("events"), hours).alias("events_per_hour"))


def split_phases(tasks: DataFrame, first_event: DataFrame, median_pct: DataFrame, keys: list[str], order: list[str],
                 chunk: Column) -> DataFrame:
    """``arm`` (treated, control) and ``phase`` (pre, post) of every task.

    Treated sessions split at their first event. Sessions without an event split
    at the same relative place: task rank < clamp(floor(n * median / 100), 1, n - 1),
    at least 1. ``first_event``: session_id, event_s. ``median_pct``: keys, median_pct.
    """
    ranked = S.ordered(tasks, [*keys, "session_id"], order, chunk, nth=S.position(), session_n=S.count_all())
    j = ranked.join(first_event, "session_id", "left").join(median_pct, keys, "left")
    n = F.col("session_n")
    cut = F.greatest(F.lit(1), F.least(F.floor(n * F.coalesce("median_pct", F.lit(50.0)) / 100), n - 1))
    treated = F.col("event_s").isNotNull()
    pre = F.when(treated, F.col("start_s") < F.col("event_s")).otherwise(F.col("nth") - 1 < cut)
    return j.withColumn("arm", F.when(treated, "treated").otherwise("control")).withColumn(
        "phase", F.when(pre, "pre").otherwise("post"))


OUTCOMES = ["avg_alignment", "satisfaction_rate", "dissatisfaction_rate", "completion_rate", "user_correction_rate"]


def outcome_metrics(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Null where a group has no data for a measure. Medians come from ``outcome_medians``."""
    s, c = F.col("normalized_user_sentiment"), F.col("task_completion")
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("alignment_score").alias("avg_alignment"),
        ratio(F.count_if(s == "satisfied"), F.count(s)).alias("satisfaction_rate"),
        ratio(F.count_if(s == "dissatisfied"), F.count(s)).alias("dissatisfaction_rate"),
        ratio(F.count_if(c == "complete"), F.count(c)).alias("completion_rate"),
        ratio(F.sum("user_corrections"), F.sum("edit_count")).alias("user_correction_rate"))


def outcome_medians(tasks: DataFrame, keys: list[str]) -> DataFrame:
    return R.quantiles(tasks, keys, "alignment_score", {"median_alignment": 0.5})


def difference_in_differences(metrics: DataFrame, keys: list[str], measures: list[str] = OUTCOMES) -> DataFrame:
    """``metrics``: keys, arm, phase, measures. Long rows with treated delta, control delta, effect."""
    long = metrics.select(*keys, "arm", "phase", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])))
    def cell(arm: str, phase: str) -> Column:
        return F.max(F.when((F.col("arm") == arm) & (F.col("phase") == phase), F.col("value")))
    wide = long.groupBy(*keys, "measure").agg(
        cell("treated", "pre").alias("pre"), cell("treated", "post").alias("post"),
        cell("control", "pre").alias("control_pre"), cell("control", "post").alias("control_post"))
    d, c = F.col("post") - F.col("pre"), F.col("control_post") - F.col("control_pre")
    return wide.select("*", d.alias("delta"), c.alias("control_delta"), (d - c).alias("effect"))
