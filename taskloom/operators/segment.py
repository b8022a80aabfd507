"""Cutting sessions into tasks.

Input: a message table with ``session_id, msg_index, type, user_text,
is_tool_result``. All scans run over blocks of message indexes, so one huge
session is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions import outcome as O
from taskloom.functions import text as T
from taskloom.operators import scan as S


def starts_task(tags: list[str] | None = None):
    """A user message that is neither a tool result nor skipped."""
    return (
        (F.col("type") == "user")
        & ~F.col("is_tool_result")
        & ~T.is_skipped(F.coalesce("user_text", F.lit("")), tags)
    )


def mark_tasks(messages: DataFrame, tags: list[str] | None = None, chunk_size: int = 4096) -> DataFrame:
    """Add ``is_start``, ``task_n`` (0 before the first task) and ``last_index`` of the session."""
    flagged = messages.withColumn("is_start", F.coalesce(starts_task(tags), F.lit(False)))
    return S.ordered(
        flagged, ["session_id"], ["msg_index"], S.index_chunk("msg_index", chunk_size),
        task_n=S.total(F.col("is_start").cast("long")),
        last_index=S.overall_max(F.col("msg_index")),
    )


def task_id():
    """W2."""
    return F.concat_ws("-", "session_id", F.lit("task"), F.col("task_n").cast("string"))


def task_starts(marked: DataFrame, chunk_size: int = 4096) -> DataFrame:
    """One row per task with prompt, index range and the text that ended it.

    ``next_text`` is null for the last task of the session.
    """
    starts = marked.where("is_start")
    chained = S.ordered(
        starts, ["session_id"], ["msg_index"], S.index_chunk("msg_index", chunk_size),
        _next=S.next_after(F.struct("msg_index", "user_text")),
    )
    return chained.select(
        task_id().alias("task_id"),
        *[F.col(c) for c in starts.columns if c not in ("msg_index", "last_index", "is_start", "user_text", "blocks")],
        F.col("user_text").alias("prompt"),
        F.col("msg_index").alias("msg_index_start"),
        F.coalesce(F.col("_next.msg_index") - 1, F.col("last_index")).alias("msg_index_end"),
        F.col("_next.user_text").alias("next_text"),
    )


def with_outcome(starts: DataFrame) -> DataFrame:
    """W3 + C1."""
    return starts.withColumn("_o", O.task_outcome(F.col("next_text"))).select(
        *starts.columns,
        F.coalesce("next_text", F.lit("")).alias("next_user_message"),
        F.col("_o.category").alias("outcome_category"),
        F.col("_o.evidence").alias("outcome_evidence"),
    )


def basic_segments(marked: DataFrame) -> DataFrame:
    """W27 + C2: tasks with their completion signal; ``marked`` uses the basic skip tags.

    Tool calls are counted inside the task only.
    """
    starts = task_starts(marked).where(T.stripped(F.col("prompt")) != "")
    signal = O.completion_signal(F.col("next_text"))
    return starts.select(
        "task_id", "session_id", "task_n",
        F.col("prompt").alias("user_prompt"),
        signal.alias("completion_signal"),
        (signal != "user_dissatisfied").alias("appears_successful"),
        "msg_index_start", "msg_index_end",
    )


def segment_durations(marked: DataFrame) -> DataFrame:
    """Seconds from the first to the last time-stamped message of a task."""
    inside = marked.where("task_n > 0").withColumn("_at", F.when(F.col("ts").isNotNull(), F.col("msg_index")))
    return inside.groupBy("session_id", "task_n").agg(
        F.min(F.when(F.col("is_start"), F.col("ts"))).alias("start_ts"),
        F.max_by("ts", "_at").alias("end_ts"),
    ).withColumn("duration_seconds", F.coalesce(S.seconds_between("start_ts", "end_ts"), F.lit(0.0)))
