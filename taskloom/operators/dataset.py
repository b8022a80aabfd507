"""Sessions, distributions and dataset overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import patterns as P
from taskloom.functions import signals as G
from taskloom.functions.numbers import mean0, percent, ratio, ratio0
from taskloom.operators import scan as S


# --- A1, P10, P11 ------------------------------------------------------------
def resolve_model(model: Column, aliases: dict[str, str]) -> Column:
    """Alias to model id, other ids stay."""
    return _mapped(model, aliases, model)


def cohort_of(model: Column, cohorts: dict[str, str]) -> Column:
    """Model id to cohort, ``other`` when unknown."""
    return _mapped(model, cohorts, F.lit("other"))


def _mapped(key: Column, table: dict[str, str], default: Column) -> Column:
    if not table:
        return default
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def sessions(messages: DataFrame, aliases: dict[str, str] | None = None, cohorts: dict[str, str] | None = None,
             meta_project: str | None = None) -> DataFrame:
    """A1: one row per session; sessions without a time stamp, an assistant message or a model are dropped.

    Model and tool counts are counted per (session, name) first, so the maps
    hold distinct names only.
    """
    assistant = F.col("type") == "assistant"
    calls = F.filter("blocks", lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")
    base = messages.groupBy("session_id").agg(
        F.first("file_path").alias("file_path"), F.first("project_path").alias("project_path"),
        F.count_if(F.col("type") == "user").alias("user_message_count"),
        F.count_if(assistant).alias("assistant_message_count"),
        F.sum(F.when(assistant, F.coalesce(F.size(calls), F.lit(0))).otherwise(0)).alias("tool_call_count"),
        F.min("ts_raw").alias("start_time"), F.max("ts_raw").alias("end_time"),
        F.count(F.lit(1)).alias("message_count"), F.max("msg_index").alias("last_index"))
    models = messages.where(assistant & F.col("model").isNotNull()).groupBy(
        "session_id", resolve_model(F.col("model"), aliases or {}).alias("model")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("msg_index").alias("seen"))
    model_map = models.groupBy("session_id").agg(
        F.max_by("model", F.struct("n", -F.col("seen"))).alias("model"),
        F.map_from_entries(F.collect_list(F.struct("model", "n"))).alias("model_counts"))
    tools = messages.where(assistant).select("session_id", F.explode(calls).alias("b")).groupBy(
        "session_id", F.coalesce(F.try_variant_get("b", "$.name", "string"), F.lit("unknown")).alias("tool")
    ).agg(F.count(F.lit(1)).alias("n"))
    tool_map = tools.groupBy("session_id").agg(
        F.map_from_entries(F.collect_list(F.struct("tool", "n"))).alias("tools_used"))
    out = base.where("start_time is not null and assistant_message_count > 0").join(
        model_map, "session_id").join(tool_map, "session_id", "left")
    start, end = F.try_to_timestamp("start_time"), F.try_to_timestamp("end_time")
    return out.withColumn("start_ts", start).withColumn("end_ts", end).withColumn(
        "duration_minutes", F.coalesce(S.seconds_between("start_ts", "end_ts") / 60, F.lit(0.0))
    ).withColumn("tools_used", F.coalesce("tools_used", F.expr("map()").cast("map<string,bigint>"))).withColumn(
        "cohort", cohort_of(F.col("model"), cohorts or {})
    ).withColumn("is_meta", F.col("project_path").contains(meta_project) if meta_project else F.lit(False))


# --- A12, A13, J17 -----------------------------------------------------------
def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count and percent of every value within ``keys``; totals come from the counts."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count"))
    if not keys:
        total = counts.agg(F.sum("count").alias("n")).select("n").scalar()
        return counts.withColumn("pct", percent(F.col("count"), total))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_n"))
    return S.join_keys(counts, totals, keys).withColumn("pct", percent(F.col("count"), F.col("_n"))).drop("_n")


def side_by_side(df: DataFrame, key: list[str], value: str, cohorts: tuple[str, str]) -> DataFrame:
    """One column per cohort, every key of either cohort."""
    a, b = cohorts
    wide = df.groupBy(*key).pivot("cohort", [a, b]).agg(F.first(value))
    return wide.select(*key, F.col(a).alias("a"), F.col(b).alias("b"))


def unknown_rate(df: DataFrame, cohort: str, value: str, unknown: str = "unknown") -> DataFrame:
    """Per cohort and combined (null cohort) share of unknown values."""
    return df.rollup(cohort).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(value) == unknown).alias("unknown"),
        percent(F.count_if(F.col(value) == unknown), F.count(F.lit(1))).alias("unknown_pct"))


# --- A14, A15, A16, P20 ------------------------------------------------------
def session_overview(sess: DataFrame) -> DataFrame:
    """A14, A15, P20 for sessions: per cohort and combined (null cohort)."""
    minutes = F.col("duration_minutes")
    usable = F.when((minutes != 0) & (minutes < 1440), minutes)
    day = F.substring("start_time", 1, 10)
    return sess.rollup("cohort").agg(
        F.count(F.lit(1)).alias("sessions"), F.countDistinct("project_path").alias("projects"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.sum("user_message_count").alias("user_messages"), F.sum("assistant_message_count").alias("assistant_messages"),
        F.sum("tool_call_count").alias("tool_calls"), (F.sum(usable) / 60).alias("session_hours"))


def tool_totals(sess: DataFrame, keys: list[str]) -> DataFrame:
    """Calls per tool over all sessions."""
    return sess.select(*keys, F.explode("tools_used").alias("tool", "n")).groupBy(*keys, "tool").agg(
        F.sum("n").alias("calls"))


def task_overview(tasks: DataFrame) -> DataFrame:
    """A14, A15 for tasks: per cohort and combined."""
    seconds = F.col("duration_seconds")
    return tasks.rollup("cohort").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("total_files_touched").alias("files_touched"),
        F.sum("total_lines_added").alias("lines_added"), F.sum("total_lines_removed").alias("lines_removed"),
        F.avg(F.when(seconds > 0, seconds)).alias("avg_task_seconds"),
        F.avg("tool_count").alias("avg_tools"), F.avg("total_files_touched").alias("avg_files"))


def scope_by(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Size of the work per complexity."""
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("total_files_touched").alias("avg_files_touched"),
        F.avg("total_lines_added").alias("avg_lines_added"), F.avg("total_lines_removed").alias("avg_lines_removed"),
        F.avg("tool_count").alias("avg_tool_calls"), F.sum("total_files_touched").alias("total_files_touched"),
        F.sum("total_lines_added").alias("total_lines_added"), F.sum("total_lines_removed").alias("total_lines_removed"))


def cleaning_stats(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, and one row per exclusion reason and flag."""
    kept = F.col("exclude_reason") == ""
    items = F.concat(
        F.array(F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")),
                F.struct(F.lit("status").alias("kind"), F.when(kept, "included").otherwise("excluded").alias("name"))),
        F.when(kept, F.transform("flags", lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("name"))))
        .otherwise(F.array(F.struct(F.lit("reason").alias("kind"), F.col("exclude_reason").alias("name")))))
    return tasks.select(*keys, F.inline(items)).groupBy(*keys, "kind", "name").agg(F.count(F.lit(1)).alias("count"))


# --- A33, A34, A38 -----------------------------------------------------------
def efficiency(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Means of per-task ratios over tasks with changes."""
    tools, files = F.col("tool_count"), F.col("total_files_touched")
    lines = F.col("total_lines_added") + F.col("total_lines_removed")
    changed = files > 0
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(changed).alias("with_changes"),
        F.avg(tools).alias("avg_tools"), mean0(F.when(changed, files)).alias("avg_files"),
        mean0(F.when(lines > 0, lines)).alias("avg_lines"),
        mean0(F.when(changed, tools / files)).alias("tools_per_file"),
        mean0(F.when(changed & (lines > 0), tools / (lines / 100))).alias("tools_per_100_lines"),
        percent(F.count_if(F.col("outcome_category") == "dissatisfaction"), F.count(F.lit(1))).alias("dissat_pct"))


def mean_scores(df: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """Mean of each score."""
    return df.groupBy(*keys).agg(*[mean0(F.col(s)).alias(s) for s in scores])


def common_items(df: DataFrame, keys: list[str], items: str, k: int = 5) -> DataFrame:
    """The k most frequent strings over all lists, ties by name."""
    from taskloom.operators.timing import top_per_group

    counts = df.select(*keys, F.explode(items).alias("item")).groupBy(
        *keys, F.lower(F.trim("item")).alias("item")).agg(F.count(F.lit(1)).alias("count"))
    return top_per_group(counts, keys, [F.desc("count"), F.asc("item")], k)


def run_efficiency(runs: DataFrame) -> DataFrame:
    """Null-safe ratios of a replayed run against the original."""
    o, r = "original_metrics", "replication_metrics"
    lines = F.col(f"{o}.lines_added") + F.col(f"{o}.lines_removed")
    return runs.select(
        "run_id", "task", "model", "original_model",
        ratio(F.col(f"{r}.total_tools"), lines / 100).alias("tools_per_100_lines"),
        ratio(F.col(f"{r}.duration_seconds"), F.col(f"{r}.total_tools")).alias("seconds_per_tool"),
        ratio(F.col(f"{r}.total_tools"), F.col(f"{o}.tools")).alias("tool_ratio"),
        ratio(F.col(f"{r}.duration_seconds"), F.col(f"{o}.duration_seconds")).alias("duration_ratio"),
        F.col("verification.overall_success").alias("passed"))


# --- A39, A40 ----------------------------------------------------------------
def consistency(counts: DataFrame, base: DataFrame) -> DataFrame:
    """Outputs per cohort that are empty or larger than the included canonical tasks.

    ``counts``: output, cohort, n. ``base``: cohort, included.
    """
    joined = counts.join(base, "cohort", "left")
    n, top = F.col("n"), F.col("included")
    return joined.withColumn("status", F.when(n <= 0, "empty").when(n > top, "too_many").otherwise("ok"))


def readiness(measured: DataFrame, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """``area, n, best_p`` against minimum sample and highest p of every area."""
    pairs_n = [F.lit(x) for a, (n, _p) in thresholds.items() for x in (a, float(n))]
    pairs_p = [F.lit(x) for a, (_n, p) in thresholds.items() for x in (a, float(p))]
    need = F.try_element_at(F.create_map(*pairs_n), F.col("area"))
    top = F.try_element_at(F.create_map(*pairs_p), F.col("area"))
    return measured.select("*", need.alias("needed_n"), top.alias("needed_p"),
                           ((F.col("n") >= need) & (F.col("best_p") <= top)).alias("ready"))


# --- A43, A44, S16 -----------------------------------------------------------
def extraction_summary(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """A43."""
    edits = F.sum("edit_event_count")
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), F.avg("input_tokens").alias("avg_input_tokens"),
        F.avg("output_tokens").alias("avg_output_tokens"), F.sum("estimated_cost").alias("total_cost"),
        ratio0(edits, edits + F.sum("failed_edit_count")).alias("edit_success"),
        F.count_if("used_planning").alias("planning_tasks"), F.count_if("used_subagents").alias("subagent_tasks"),
        F.count_if(F.col("parallel_tool_messages") > 0).alias("parallel_tasks"))


def annotation_summary(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Means over positive values and counts by sentiment bucket."""
    bucket = G.sentiment_bucket(F.col("user_sentiment"))
    return annotated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), mean0(F.when(F.col("alignment_score") > 0, F.col("alignment_score"))).alias("avg_score"),
        mean0(F.when(F.col("lines_per_minute") > 0, F.col("lines_per_minute"))).alias("avg_lines_per_minute"),
        mean0(F.when(F.col("tools_per_file") > 0, F.col("tools_per_file"))).alias("avg_tools_per_file"),
        *[F.count_if(bucket == b).alias(b) for b in ("satisfied", "collaborative", "neutral", "dissatisfied", "other")])


def metric_catalogue(wide: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Every numeric column of an aggregate as (cohort, name, value)."""
    numeric = [f.name for f in wide.schema.fields
               if f.name not in keys and f.dataType.simpleString() in ("bigint", "int", "double", "float")]
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(f"{prefix}.{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in numeric])))
