"""From session logs to findings: the whole analysis as one Spark program.

Every step is a function of DataFrames. Three kinds of table are written on the
way (messages, canonical tasks with their events, enriched tasks), because many
later steps read them; everything else is one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.config import Measurements
from taskloom.operators import abtests as AB
from taskloom.operators import annotate as AN
from taskloom.operators import dataset as D
from taskloom.operators import edits as E
from taskloom.operators import findings as FI
from taskloom.operators import tasks as TK
from taskloom.operators import tokens as TOK
from taskloom.sources import logs
from taskloom.sources.stage import stage


@dataclass
class Results:
    """All tables of one analysis; ``tasks`` holds included tasks, ``all_tasks`` also excluded ones."""

    sessions: DataFrame
    all_tasks: DataFrame
    tasks: DataFrame
    calls: DataFrame
    requests: DataFrame
    compactions: DataFrame
    edits: DataFrame
    overlaps: DataFrame
    edit_metrics: DataFrame
    annotated: DataFrame
    enriched: DataFrame
    tests: DataFrame
    restricted_tests: DataFrame
    findings: DataFrame
    cohorts: tuple[str, str] = field(default=("a", "b"))


def token_table(tasks: DataFrame) -> DataFrame:
    """A5: token columns under their report names."""
    return tasks.select(
        "*", F.col("input_tokens").alias("total_input_tokens"), F.col("output_tokens").alias("total_output_tokens"),
        F.floor(F.col("thinking_chars") / 3).alias("estimated_thinking_tokens"),
        F.floor(F.col("text_chars") / 4).alias("estimated_text_tokens"))


def analyse(spark: SparkSession, paths: str | list[str], cohorts: dict[str, str], annotations: DataFrame | None = None,
            aliases: dict[str, str] | None = None, prices: DataFrame | None = None,
            measurements: Measurements = Measurements(), exclude_projects: tuple[str, ...] = (),
            meta_project: str | None = None, home_project: str = "") -> Results:
    """Run everything. ``cohorts`` maps model ids to the two cohort names."""
    messages = stage(logs.read_messages(spark, paths, exclude_projects), "messages")
    sess = stage(D.sessions(messages, aliases, cohorts, meta_project).where("cohort <> 'other'"), "sessions")
    mine = messages.join(sess.select("session_id"), "session_id", "left_semi")

    tables = TK.canonical(mine, stage=stage, meta_project=meta_project, home_project=home_project)
    by_session = sess.select("session_id", "cohort")
    all_tasks = TK.priced(tables.tasks.drop("estimated_cost").join(by_session, "session_id"), prices)
    all_tasks = stage(token_table(all_tasks), "all-tasks")
    tasks = all_tasks.where("exclude_reason = ''")

    named = tasks.select("session_id", "task_n", "task_id", "cohort")
    events = tables.edits.join(named, ["session_id", "task_n"])
    done = stage(E.prepare(events.where("succeeded")), "edit-events")
    found = stage(E.overlaps(done, stage), "overlaps")
    context = E.edit_context(tasks, tables.errors)
    overlaps = stage(E.classify_overlaps(found, context, E.chain_depths(found, stage)).join(
        by_session, "session_id"), "classified-overlaps")
    flags = E.task_flags(tables.calls.join(named, ["session_id", "task_n"]), tasks)
    metrics = stage(E.edit_metrics(done, overlaps, events, flags).join(by_session, "session_id"), "edit-metrics")

    signals = E.edit_signals(tables.edits, tables.errors, tasks)
    notes = AN.validated(annotations if annotations is not None else spark.createDataFrame([], "task_id string"))
    annotated = stage(AN.annotate(tasks, notes, signals), "annotated")
    classified = tasks.select("task_id", F.col("classification.type").alias("type"))
    tokens = tasks.select("task_id", *AN.TOKEN_FIELDS)
    rich = stage(AN.enrich(annotated, tokens, metrics, classified), "enriched")

    pair = tuple(sorted(set(cohorts.values())))
    if len(pair) != 2:
        raise ValueError(f"expected two cohorts, got {pair}")
    tests = stage(AB.adjust(AB.run_tests(rich, pair, measurements), alpha=measurements.alpha), "tests")
    narrow = stage(AB.adjust(AB.run_tests(AB.restricted(rich, pair), pair, measurements), alpha=measurements.alpha),
                   "restricted-tests")

    def labelled(events_: DataFrame) -> DataFrame:
        return events_.join(named, ["session_id", "task_n"])

    return Results(
        sess, all_tasks, tasks, labelled(tables.calls), labelled(tables.requests), tables.compactions, done, overlaps,
        metrics, annotated, rich, tests, narrow, FI.findings(tests, pair), pair)


def thinking_settings(messages_marked: DataFrame) -> DataFrame:
    """A5: thinking configuration per task."""
    return TOK.thinking_config(messages_marked)
