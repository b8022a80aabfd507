"""Task queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import text as T

SORTS = {"tools": "tool_count", "files": "total_files_touched", "duration": "duration_seconds", "lines": "total_lines_added"}


def filter_tasks(tasks: DataFrame, min_tools: int = 0, min_files: int = 0, outcome: str | None = None,
                 prompt_pattern: str | None = None, project: str | None = None, task_type: str | None = None,
                 complexity: str | None = None, exclude_continuations: bool = False) -> DataFrame:
    """Only the given conditions; each one is an ordinary filter that Spark can push down."""
    out = tasks
    if min_tools:
        out = out.where(F.col("tool_count") >= min_tools)
    if min_files:
        out = out.where(F.col("total_files_touched") >= min_files)
    if outcome:
        out = out.where(F.col("outcome_category") == outcome)
    if prompt_pattern:
        out = out.where(T.matches(F.col("user_prompt"), f"(?i){prompt_pattern}"))
    if project:
        out = out.where(F.lower("project_path").contains(project.lower()))
    if task_type:
        out = out.where(F.col("classification.type") == task_type)
    if complexity:
        out = out.where(F.col("classification.complexity") == complexity)
    if exclude_continuations:
        out = out.where(F.col("classification.type") != "continuation")
    return out


def listed(tasks: DataFrame, sort: str = "tools", limit: int = 20) -> DataFrame:
    """Distributed top-n."""
    return tasks.orderBy(F.desc(SORTS[sort]), "task_id").limit(limit)


def find(tasks: DataFrame, part: str) -> DataFrame:
    """First task whose id contains a string."""
    return tasks.where(F.col("task_id").contains(part)).orderBy("task_id").limit(1)


def words(text: Column) -> Column:
    """Distinct lower-case words, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0),
                  F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def similarity(words_a, words_b, tools_a, tools_b, files_a, files_b) -> Column:
    """0.5 word Jaccard + 0.3 tool Jaccard + 0.2 scale."""
    scale = F.when(files_a + files_b > 0,
                   1 - F.abs(files_a - files_b) / F.greatest(files_a + files_b, F.lit(1))).otherwise(1.0)
    return 0.5 * jaccard(words_a, words_b) + 0.3 * jaccard(tools_a, tools_b) + 0.2 * scale


def similar_to(tasks: DataFrame, target: DataFrame, k: int = 5) -> DataFrame:
    """The k tasks most similar to one task.

    ``tasks`` and ``target``: task_id, user_prompt, tools (array), files. The
    target is a single row and enters as a scalar subquery, so the table is
    scanned once and each task keeps its own k best rows.
    """
    one = target.select(F.struct(
        "task_id", words(F.col("user_prompt")).alias("words"), "tools", "files")).scalar()
    split = tasks.select("task_id", "tools", "files", words(F.col("user_prompt")).alias("_words"))
    scored = split.withColumn("_t", one).where(F.col("task_id") != F.col("_t.task_id")).select(
        "task_id",
        similarity(F.col("_t.words"), F.col("_words"), F.col("_t.tools"), F.col("tools"),
                   F.col("_t.files"), F.col("files")).alias("score"))
    return scored.orderBy(F.desc("score"), "task_id").limit(k)


def compare_two(tasks: DataFrame, first: str, second: str) -> DataFrame:
    """Six measures of two tasks as rows; ids match by substring, the last match wins."""
    def side(part: str, name: str) -> DataFrame:
        row = tasks.where(F.col("task_id").contains(part)).orderBy(F.desc("task_id")).limit(1)
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("o"), F.lit(label).alias("metric"), F.col(c).cast("string").alias(name))
            for i, (label, c) in enumerate([
                ("Tool calls", "tool_count"), ("Files touched", "total_files_touched"),
                ("Lines added", "total_lines_added"), ("Lines removed", "total_lines_removed"),
                ("Duration (s)", "duration_seconds"), ("Outcome", "outcome_category")])])))
    return side(first, "task_1").join(side(second, "task_2"), ["o", "metric"], "full").orderBy("o").drop("o")


def replication_candidates(tasks: DataFrame, k: int = 10) -> DataFrame:
    """At least 3 tools, clear outcome, at most 600 s and 20 reads, by score."""
    clear = F.col("outcome_category").isin("satisfaction", "dissatisfaction")
    fit = tasks.where((F.col("tool_count") >= 3) & (clear | (F.col("outcome_category") == "new_task"))
                      & (F.col("duration_seconds") <= 600) & (F.col("read_calls") <= 20))
    score = (F.least("tool_count", F.lit(20)) / 20 + F.when(clear, 1.0).otherwise(0.5)
             + F.least("total_files_touched", F.lit(5)) / 5)
    return fit.withColumn("score", score).orderBy(F.desc("score"), "task_id").limit(k)


def replication_rows(candidates: DataFrame, files: DataFrame, first: int = 10) -> DataFrame:
    """Export rows with their first ten files, numbered as a batch.

    ``candidates`` holds the few rows chosen by P18.
    """
    from pyspark.sql.window import Window

    key = ["session_id", "task_n"]
    # distinct files are cut to the first ones of a task in every mapper (window group limit), so a task of any size sends ten rows
    wanted = files.join(candidates.select(*key), key, "left_semi").select(*key, "file").distinct()
    ordered = wanted.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("file"))).where(F.col("_n") <= first)
    lists = ordered.groupBy(*key).agg(F.array_sort(F.collect_list("file")).alias("files"))
    by_score = Window.partitionBy("_all").orderBy(F.desc("score"), "task_id")
    return candidates.withColumn("_all", F.lit(0)).withColumn("number", F.row_number().over(by_score)).join(
        lists, key, "left").select(
        "number", "task_id", "user_prompt", F.col("tool_count").alias("tools"), "total_files_touched",
        "total_lines_added", "total_lines_removed", "duration_seconds", "outcome_category", "files")
