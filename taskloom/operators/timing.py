"""Gaps, active time, explore phase and request timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import classify as C
from taskloom.functions import patterns as P
from taskloom.functions.numbers import mean0, percent, ratio, ratio0
from taskloom.operators import ranks as R
from taskloom.operators import scan as S


# --- W13, A31, A32 -----------------------------------------------------------
def task_gaps(tasks: DataFrame, keys: list[str], tie: str, width: float = S.HOUR * 24) -> DataFrame:
    """``gap_seconds`` from the last known end of an earlier task of the session.

    ``tasks``: keys, start_s, end_s (null when unknown), and ``tie`` to order equal starts.
    """
    chained = S.ordered(
        tasks, keys, ["start_s", tie], S.time_chunk(F.col("start_s"), width),
        prev_end_s=S.latest_before(F.col("end_s")),
    )
    return chained.withColumn("gap_seconds", F.col("start_s") - F.col("prev_end_s"))


def active_time_cost(gapped: DataFrame, group: list[str], session: list[str],
                     thresholds=P.GAP_THRESHOLDS_MIN) -> DataFrame:
    """Active hours and cost per active hour for every gap threshold.

    One conditional sum per threshold, so the input is folded once per session
    and the thresholds never multiply rows. ``gapped`` needs gap_seconds,
    duration_seconds and estimated_cost.
    """
    gap, dur = F.col("gap_seconds"), F.col("duration_seconds")
    work = F.sum(F.when(dur > 0, dur).otherwise(0.0))
    per_session = gapped.groupBy(*group, *session).agg(
        F.sum("estimated_cost").alias("cost"), F.count(F.lit(1)).alias("tasks"),
        *[(work + F.sum(F.when((gap > 0) & (gap <= m * 60), gap).otherwise(0.0))).alias(f"t{m}") for m in thresholds])
    stacked = per_session.select(
        *group, "cost",
        F.inline(F.array(*[F.struct(F.lit(m).alias("threshold_min"), F.col(f"t{m}").alias("active_s"))
                           for m in thresholds])))
    active = F.sum("active_s") / 3600
    return stacked.groupBy(*group, "threshold_min").agg(
        active.alias("total_active_hours"), F.sum("cost").alias("total_cost"),
        ratio0(F.sum("cost"), active).alias("cost_per_active_hour"),
        F.count_if(F.col("active_s") > 0).alias("session_count"),
        F.avg(F.when(F.col("active_s") > 0, F.col("cost") / (F.col("active_s") / 3600))).alias("mean_session_rate"))


def gap_stats(gapped: DataFrame, keys: list[str], split_s: float = 300.0) -> DataFrame:
    """All positive gaps, and those up to / above five minutes."""
    gaps = gapped.where("gap_seconds > 0").select(*keys, "gap_seconds")
    bands = F.array(F.lit("all"), F.when(F.col("gap_seconds") <= split_s, "short").otherwise("long"))
    return R.summary_stats(gaps.withColumn("band", F.explode(bands)), [*keys, "band"], "gap_seconds")


# --- A11 ---------------------------------------------------------------------
def bucket_name(value: Column, buckets=P.DURATION_BUCKETS) -> Column:
    rule = None
    for name, lo, hi in buckets:
        inside = (value >= lo) if hi is None else (value >= lo) & (value < hi)
        rule = F.when(inside, name) if rule is None else rule.when(inside, name)
    return rule


def duration_buckets(df: DataFrame, keys: list[str], seconds: str, buckets=P.DURATION_BUCKETS) -> DataFrame:
    """Count and percent of positive durations per bucket; empty buckets stay."""
    per_key = df.where(F.col(seconds) > 0).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean_seconds"),
        *[F.count_if(bucket_name(F.col(seconds), buckets) == name).alias(name) for name, _l, _h in buckets])
    return per_key.select(
        *keys, "n", "mean_seconds",
        F.inline(F.array(*[F.struct(F.lit(i).alias("bucket_order"), F.lit(name).alias("bucket"),
                                    F.col(name).alias("count"))
                           for i, (name, _l, _h) in enumerate(buckets)]))
    ).withColumn("pct", percent(F.col("count"), F.col("n")))


# --- W20 ---------------------------------------------------------------------
def tool_ngrams(calls: DataFrame, task: list[str], order: list[str], chunk: Column, group: list[str]) -> DataFrame:
    """Counts of 2- and 3-grams of consecutive tool names inside a task."""
    one = S.ordered(calls, task, order, chunk, second=S.next_after(F.col("name")))
    two = S.ordered(one, task, order, chunk, third=S.next_after(F.col("second")))
    grams = two.where("second is not null").select(
        *group, F.explode(F.array_compact(F.array(
            F.struct(F.lit(2).alias("size"), F.concat_ws("->", "name", "second").alias("gram")),
            F.when(F.col("third").isNotNull(),
                   F.struct(F.lit(3).alias("size"), F.concat_ws("->", "name", "second", "third").alias("gram"))),
        ))).alias("g")).select(*group, "g.size", "g.gram")
    return grams.groupBy(*group, "size", "gram").agg(F.count(F.lit(1)).alias("count"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group. Spark prunes to k rows per group and task
    (window group limit) before the shuffle."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- W21 ---------------------------------------------------------------------
def explore_phase(calls: DataFrame, tasks: DataFrame, key: list[str], write_tools=P.WRITE_TOOLS,
                  read_tool: str = "Read") -> DataFrame:
    """W21 per task: seconds from task start to the first write call and its share of the duration.

    ``calls``: key, name, at_s. ``tasks``: key, start_s, duration_seconds.
    """
    writes = F.col("name").isin(list(write_tools))
    per_task = calls.groupBy(*key).agg(
        F.bool_or(writes).alias("has_write"),
        F.bool_or(F.col("name") == read_tool).alias("has_read"),
        F.min(F.when(writes, F.col("at_s"))).alias("first_write_s"))
    seconds = F.col("first_write_s") - F.col("start_s")
    joined = tasks.where("duration_seconds > 0 and start_s is not null").join(per_task, key)
    usable = F.col("has_write") & (seconds >= 0)
    return joined.select(
        *tasks.columns, "has_write",
        (~F.col("has_write") & F.col("has_read")).alias("explore_only"),
        F.when(usable, seconds).alias("explore_seconds"),
        F.when(usable, seconds / F.col("duration_seconds")).alias("explore_ratio"))


# --- W22, W23, A30 -----------------------------------------------------------
def first_requests(requests: DataFrame, task: list[str], order: list[str]) -> DataFrame:
    """``is_first`` of each task and ``n`` requests, from one partial aggregate.

    ``order`` ends with what tells requests of one time apart, so that each task has one first request.
    A request without a time is never the first.
    """
    head = requests.groupBy(*task).agg(F.min(F.when(F.col(order[0]).isNotNull(), F.struct(*order))).alias("_first"), F.count(F.lit(1)).alias("request_n"))
    return S.join_keys(requests, head, task).withColumn("is_first", F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False))).drop("_first")


def cold_warm(requests: DataFrame, task: list[str], order: list[str], group: list[str]) -> DataFrame:
    """First request against the later ones, tasks with at least two requests."""
    r = first_requests(requests, task, order).where("request_n >= 2")
    first = F.col("is_first")
    return r.groupBy(*group).agg(
        F.count_if(first).alias("tasks_analyzed"),
        F.avg(F.when(first, F.col("cache_write"))).alias("avg_first_write"),
        F.avg(F.when(~first, F.col("cache_write"))).alias("avg_later_write"),
        F.avg(F.when(first, F.col("cache_read"))).alias("avg_first_read"),
        F.avg(F.when(~first, F.col("cache_read"))).alias("avg_later_read"),
    ).withColumn("cold_write_ratio", ratio0(F.col("avg_first_write"), F.col("avg_later_write")))


def request_timing(tasks: DataFrame, requests: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """Statistics of turn time, request time, first request and model-time share, as long rows."""
    timed = requests.withColumn("seconds", S.seconds_between("first_ts", "last_ts")).where("seconds >= 0")
    firsts = first_requests(timed, key, ["first_index", "request_id"])
    named = tasks.select(*key, *group, "turn_duration_ms", "duration_seconds")
    req = firsts.join(named.select(*key, *group), key).select(
        *group, F.explode(F.array_compact(F.array(
            F.struct(F.lit("request_seconds").alias("measure"), F.col("seconds").alias("value")),
            F.when(F.col("is_first"), F.struct(F.lit("first_request_seconds").alias("measure"),
                                               F.col("seconds").alias("value")))))).alias("m")
    ).select(*group, "m.*")
    share = F.col("turn_duration_ms") / 1000.0 / F.col("duration_seconds")
    turns = named.where("turn_duration_ms > 0").select(
        *group, F.explode(F.array_compact(F.array(
            F.struct(F.lit("turn_ms").alias("measure"), F.col("turn_duration_ms").cast("double").alias("value")),
            F.when((F.col("duration_seconds") > 0) & (share > 0) & (share <= 1),
                   F.struct(F.lit("model_time_ratio").alias("measure"), share.alias("value")))))).alias("m")
    ).select(*group, "m.*")
    return R.summary_stats(req.unionByName(turns), [*group, "measure"], "value")


# --- W16, W17, A28, A29 ------------------------------------------------------
def frontload(calls: DataFrame, task: list[str], order: list[str], chunk: Column,
              research=P.RESEARCH_TOOLS, implementation=P.WRITE_TOOLS) -> DataFrame:
    """W17/A29 per task: research and implementation shares, and research share of the
    first half minus the second half for tasks with at least four calls."""
    placed = S.ordered(calls, task, order, chunk, nth=S.position(), n=S.count_all())
    kind = C.tool_class(F.col("name"), research, implementation)
    first = F.col("nth") <= F.floor(F.col("n") / 2)
    is_research = kind == "research"
    per_task = placed.groupBy(*task).agg(
        F.max("n").alias("total_tools"),
        F.count_if(is_research).alias("research_count"),
        F.count_if(kind == "implementation").alias("impl_count"),
        F.count_if(is_research & first).alias("_r1"), F.count_if(first).alias("_n1"))
    n, r, n1, r1 = (F.col(c) for c in ("total_tools", "research_count", "_n1", "_r1"))
    return per_task.select(
        *task, "total_tools", "research_count", "impl_count",
        (r / n).alias("research_ratio"), (F.col("impl_count") / n).alias("impl_ratio"),
        F.when(n >= 4, r1 / n1 - (r - r1) / (n - n1)).alias("frontload_score"))


def effort_summary(per_task: DataFrame, group: list[str]) -> DataFrame:
    """A29."""
    score = F.col("frontload_score")
    return per_task.groupBy(*group).agg(
        F.count(F.lit(1)).alias("tasks_analyzed"),
        mean0(F.col("research_ratio")).alias("avg_research_ratio"),
        mean0(F.col("impl_ratio")).alias("avg_impl_ratio"),
        F.count(score).alias("tasks_with_frontload_data"),
        mean0(score).alias("avg_frontload_score"),
        percent(F.count_if(score > 0), F.count(score)).alias("frontload_positive_pct"))


def task_rank_in_session(tasks: DataFrame, session: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Rank of a task in its session and the size of the session."""
    return S.ordered(tasks, session, order, chunk, nth=S.position(), session_tasks=S.count_all())


def quality_measures(prefix: str = "") -> list[Column]:
    """Outcome means shared by A26, A28 and W16; rows without an annotation count as null."""
    noted = F.col("alignment_score").isNotNull() | F.col("normalized_user_sentiment").isNotNull()
    tpf = F.col("tools_per_file")
    n = F.count_if(noted)
    return [
        F.count("alignment_score").alias(f"{prefix}scored_tasks"),
        mean0(F.col("alignment_score")).alias(f"{prefix}avg_alignment_score"),
        percent(F.count_if(noted & (F.col("normalized_user_sentiment") == "satisfied")), n)
        .alias(f"{prefix}satisfaction_rate"),
        percent(F.count_if(noted & (F.col("task_completion") == "complete")), n).alias(f"{prefix}completion_rate"),
        mean0(F.when(tpf > 0, tpf)).alias(f"{prefix}avg_tools_per_file"),
    ]


def warmup(ranked: DataFrame, group: list[str], min_tasks: int = 5, early: int = 3) -> DataFrame:
    """First three tasks against the rest, sessions of five or more tasks."""
    phase = F.when(F.col("nth") <= early, "early").otherwise("later")
    return ranked.where(F.col("session_tasks") >= min_tasks).groupBy(*group, phase.alias("phase")).agg(
        F.count(F.lit(1)).alias("tasks"), *quality_measures())


def session_length(ranked: DataFrame, group: list[str], buckets=P.SESSION_BUCKETS) -> DataFrame:
    """Quality by session length."""
    rule = None
    for name, top in buckets:
        rule = (F.when(F.col("session_tasks") <= top, name) if rule is None else
                rule.when(F.col("session_tasks") <= top, name) if top else rule.otherwise(name))
    return ranked.groupBy(*group, rule.alias("bucket")).agg(
        F.count_if(F.col("nth") == 1).alias("sessions"), F.count(F.lit(1)).alias("tasks"), *quality_measures())


# --- W26, A25 ----------------------------------------------------------------
def position_in_session(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Message index of an event as percent of the last index of its session."""
    return events.join(sessions.select("session_id", "last_index"), "session_id").withColumn(
        "position_pct", ratio(F.col("msg_index") * 100.0, F.col("last_index")))
