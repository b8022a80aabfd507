"""Task tables, annotations, run results and sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# --- sinks -------------------------------------------------------------------
def write_by_cohort(df: DataFrame, path: str) -> None:
    """One directory per cohort; a cohort may still hold many files."""
    df.write.mode("overwrite").partitionBy("cohort").parquet(path)


def write_two_tiers(rows: DataFrame, aggregates: DataFrame, path: str) -> None:
    """Anonymised rows in the private tier, aggregates only in the public one."""
    write_by_cohort(rows, f"{path}/private")
    write_by_cohort(aggregates, f"{path}/public")


# --- sources -----------------------------------------------------------------
def cohorts_of(spark: SparkSession, path: str) -> list[str]:
    """S3: cohort names from the partition directories, sorted."""
    listing = spark.read.parquet(path).select("cohort").distinct()
    return sorted(r.cohort for r in listing.collect())


def read_tasks(spark: SparkSession, path: str, cohorts: list[str] | None = None,
               include_excluded: bool = False) -> DataFrame:
    """Canonical tasks; excluded rows are dropped by a filter that reaches the scan."""
    df = spark.read.parquet(path)
    if cohorts:
        df = df.where(F.col("cohort").isin(cohorts))
    return df if include_excluded else df.where("exclude_reason = ''")


def read_json_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON array files; an absent path is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_available(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first table that exists (enriched, else annotated, ...)."""
    for path in paths:
        if path_exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def fill_identity(df: DataFrame, canonical: DataFrame) -> DataFrame:
    """Project and session from the canonical tasks where they are missing."""
    known = canonical.select("task_id", F.col("project_path").alias("_p"), F.col("session_id").alias("_s"))
    have = set(df.columns)
    def fill(name: str, other: str) -> Column:
        return (F.coalesce(F.col(name), F.col(other)) if name in have else F.col(other)).alias(name)
    rest = [c for c in df.columns if c not in ("project_path", "session_id")]
    return df.join(known, "task_id", "left").select(*rest, fill("project_path", "_p"), fill("session_id", "_s"))


def analysis_with_complexity(analysis: DataFrame, classified: DataFrame) -> DataFrame:
    """S6 fallback: annotations joined to the classified complexity."""
    from taskloom.operators.annotate import lookup_complexity

    return lookup_complexity(analysis, classified)


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per task, named ``<task id>_<hash>.json``."""
    fields = ("task_completion", "user_sentiment", "sentiment_confidence", "execution_quality", "work_category",
              "scope_management", "communication_quality", "error_recovery", "iteration_required", "summary",
              "follow_up_pattern", "autonomy_level", "alignment_score", "task_type", "task_type_confidence")
    raw = spark.read.schema(", ".join(f"{f} string" for f in fields)).option("multiLine", True).option(
        "pathGlobFilter", "*.json").json(folder)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(.*)_[^_]+\.json$", 1).alias("task_id"), *fields)


RUN_SCHEMA = """run_id string, timestamp string, task string, model string, original_model string,
    original_metrics struct<tools:bigint,files_touched:bigint,lines_added:bigint,lines_removed:bigint,duration_seconds:double>,
    replication_metrics struct<duration_seconds:double,exit_code:int,total_tools:bigint,tool_breakdown:map<string,bigint>,message_count:bigint>,
    verification struct<overall_success:boolean>"""


def read_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Run results, unreadable files are skipped."""
    raw = spark.read.schema(RUN_SCHEMA + ", _bad string").option("multiLine", True).option(
        "columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(paths)
    return raw.where("run_id is not null").drop("_bad")


# --- S12 ---------------------------------------------------------------------
_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]|\[(\w+)=([^\]]+)\]")


def _has(key: str, value: str):
    return lambda x: x[key].cast("string") == F.lit(value)


def lookup(column: Column, path: str, names: dict[str, str] | None = None) -> Column:
    """Nested value by dotted path, e.g. ``{a}.tests[field=cost].p_value`` or ``rows[0].n``.

    Struct fields, map keys, list positions and ``[key=value]`` list filters become
    ordinary column accesses; ``names`` fills cohort placeholders.
    """
    for key, value in (names or {}).items():
        path = path.replace("{" + key + "}", value)
    for name, index, key, value in _STEP.findall(path):
        if name:
            column = column[name]
        elif index:
            column = F.get(column, int(index))
        else:
            column = F.get(F.filter(column, _has(key, value)), 0)
    return column


def read_spec(path: str) -> dict:
    """A small JSON specification on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
