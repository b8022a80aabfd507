"""Annotations, enrichment and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import signals as G
from taskloom.functions.numbers import ratio, ratio0

# fixed values: defaults of a task without an annotation
NO_ANNOTATION = {
    "scope_management": "appropriate", "communication_quality": "adequate", "error_recovery": "none_needed",
    "iteration_required": "one_shot", "autonomy_level": "medium", "summary": "", "follow_up_pattern": "",
    "user_sentiment": "", "sentiment_confidence": "low", "execution_quality": "", "work_category": "",
}
TOKEN_FIELDS = [
    "total_input_tokens", "total_output_tokens", "cache_read_tokens", "cache_write_tokens", "thinking_chars",
    "thinking_blocks", "text_chars", "text_blocks", "tool_use_chars", "edit_content_chars", "write_content_chars",
    "bash_command_chars", "request_count", "estimated_cost",
]
EDIT_FIELDS = [
    "edit_count", "write_count", "failed_edit_count", "overlap_count", "self_corrections", "error_recoveries",
    "user_corrections", "iterative_refinements", "max_chain_depth", "triage_score",
]


def route(tools: Column, seconds: Column, complexity: Column) -> Column:
    """Trivial, small or normal."""
    return (
        F.when((tools == 0) & (F.coalesce(seconds, F.lit(0.0)) < 10), "trivial")
        .when(complexity.isin("trivial", "simple") & (tools <= 3), "small")
        .otherwise("normal"))


def validated(raw: DataFrame) -> DataFrame:
    """Annotation rows with canonical completion, score, type and normalised fields."""
    have = set(raw.columns)
    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    base = raw.select(
        "task_id", *[text(c, d).alias(c) for c, d in NO_ANNOTATION.items()],
        G.completion(text("task_completion", "complete")).alias("task_completion"),
        G.valid_score(F.col("alignment_score").cast("string") if "alignment_score" in have
                      else F.lit(None).cast("string")).alias("alignment_score"),
        G.valid_type(text("task_type", "")).alias("task_type"),
        text("task_type_confidence", "medium").alias("task_type_confidence"))
    return base.select("*", *[c.alias(n) for n, c in G.normalised(
        F.col("execution_quality"), F.col("work_category"), F.col("user_sentiment")).items()])


def lookup_complexity(tasks: DataFrame, classified: DataFrame) -> DataFrame:
    """Complexity from the classified table, ``unknown`` when missing."""
    c = classified.select("task_id", F.col("complexity").alias("_c"))
    return tasks.join(c, "task_id", "left").withColumn("complexity", F.coalesce("_c", F.lit("unknown"))).drop("_c")


def annotate(tasks: DataFrame, annotations: DataFrame, edit_signals: DataFrame) -> DataFrame:
    """Task measures, signals and annotation in one row.

    ``annotations`` comes from ``validated``, ``edit_signals`` from
    ``edits.edit_signals``. Tasks without an annotation fall back to keywords.
    """
    kw = G.keyword_signals(F.col("next_user_message"), F.col("outcome_category"))
    signals = ["self_corrections", "error_recoveries", "user_corrections", "rewrite_rate", "max_chain_depth"]
    edit = edit_signals.select("session_id", "task_n", F.struct(*signals).alias("edit_signals"))
    lines = F.col("total_lines_added") + F.col("total_lines_removed")
    seconds = F.coalesce(F.nullif(F.col("duration_seconds"), F.lit(0.0)), F.lit(1.0))
    base = tasks.join(edit, ["session_id", "task_n"], "left").select(
        "task_id", "cohort", "session_id", "task_n", "project_path", "start_ts",
        F.col("tool_count").alias("tool_calls"), F.col("total_files_touched").alias("files_touched"),
        F.col("total_lines_added").alias("lines_added"), F.col("total_lines_removed").alias("lines_removed"),
        "duration_seconds",
        F.when(seconds > 0, lines / (seconds / 60)).otherwise(0.0).alias("lines_per_minute"),
        (F.col("tool_count") / F.greatest("total_files_touched", F.lit(1))).alias("tools_per_file"),
        F.col("classification.complexity").alias("complexity"),
        F.col("classification.type").alias("regex_type"),
        kw.alias("keyword_signals"), "edit_signals")
    notes = annotations.withColumn("has_annotation", F.lit(True))
    j = base.join(notes, "task_id", "left")
    pos, neg = F.col("keyword_signals.positive_hits"), F.col("keyword_signals.negative_hits")
    corrections = F.coalesce("edit_signals.user_corrections", F.lit(0))
    rewrites = F.coalesce("edit_signals.rewrite_rate", F.lit(0.0))
    sentiment = F.coalesce("normalized_user_sentiment", G.fallback_sentiment(pos, neg))
    sentiment = F.when((corrections > 0) & (sentiment == "satisfied"), "ambiguous").otherwise(sentiment)
    quality = F.coalesce("normalized_execution_quality", F.lit("adequate"))
    quality = F.when(rewrites > 0.3, F.when(quality == "excellent", "good").when(quality == "good", "adequate")
                     .otherwise(quality)).otherwise(quality)
    replaced = {"normalized_user_sentiment", "normalized_execution_quality", "normalized_work_category",
                "alignment_score", "task_completion", "task_type", "task_type_confidence", "has_annotation",
                *NO_ANNOTATION}
    return j.select(
        *[c for c in j.columns if c not in replaced],
        *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in NO_ANNOTATION.items()],
        F.coalesce("alignment_score", F.lit(3)).alias("alignment_score"),
        F.coalesce("task_completion", F.lit("complete")).alias("task_completion"),
        F.coalesce("task_type", F.lit("")).alias("task_type"),
        F.coalesce("task_type_confidence", F.lit("low")).alias("task_type_confidence"),
        F.coalesce("normalized_work_category", F.lit("directed_impl")).alias("normalized_work_category"),
        quality.alias("normalized_execution_quality"), sentiment.alias("normalized_user_sentiment"),
        F.coalesce("has_annotation", F.lit(False)).alias("has_annotation"),
        F.struct(
            G.keyword_sentiment(pos, neg).alias("keyword_sentiment"), sentiment.alias("llm_sentiment"),
            corrections.alias("edit_user_corrections"), rewrites.alias("edit_rewrite_rate"),
        ).alias("signal_agreement"))


def derived(df: DataFrame) -> DataFrame:
    """Ratios of enriched tasks, null where the denominator is 0."""
    def num(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))
    cost, seconds = F.col("estimated_cost"), num("duration_seconds")
    reads, inputs = num("cache_read_tokens"), num("total_input_tokens")
    think, text = num("thinking_chars"), num("text_chars")
    return df.select(
        "*",
        F.when((cost != 0) & (seconds > 0), cost / (seconds / 60)).alias("cost_per_minute"),
        F.when((num("total_output_tokens") != 0) & (num("request_count") > 0),
               F.col("total_output_tokens") / F.col("request_count")).alias("output_per_request"),
        ratio(reads, reads + inputs).alias("cache_hit_rate"),
        ratio(think, think + text).alias("thinking_fraction"),
        (num("edit_count") > 0).alias("has_edits"), (num("overlap_count") > 0).alias("has_overlaps"),
        (num("overlap_count") / F.greatest(num("edit_count") + num("write_count"), F.lit(1))).alias("rewrite_rate"))


def enrich(annotated: DataFrame, tokens: DataFrame, edit_metrics: DataFrame, classified: DataFrame,
           token_fields: list[str] = TOKEN_FIELDS, edit_fields: list[str] = EDIT_FIELDS) -> DataFrame:
    """Annotated tasks with token fields (null if missing), edit fields (0 if missing) and type.

    A column the annotated row already has keeps its value. ``tokens``,
    ``edit_metrics`` and ``classified`` hold one row per task_id.
    """
    mine = set(annotated.columns)
    tok = tokens.select("task_id", *[F.col(c).alias(f"_t_{c}") for c in token_fields], F.lit(True).alias("_tok"))
    edi = edit_metrics.select("task_id", *[F.col(c).alias(f"_e_{c}") for c in edit_fields], F.lit(True).alias("_edi"))
    cls = classified.select("task_id", F.col("type").alias("_c_type"), F.lit(True).alias("_cls"))
    j = annotated.join(tok, "task_id", "left").join(edi, "task_id", "left").join(cls, "task_id", "left")
    def pick(name: str, other: Column) -> Column:
        return (F.coalesce(F.col(name), other) if name in mine else other).alias(name)
    wanted = {c: pick(c, F.col(f"_t_{c}")) for c in token_fields}
    wanted |= {c: pick(c, F.coalesce(F.col(f"_e_{c}"), F.lit(0))) for c in edit_fields}
    wanted["task_type"] = pick("task_type", F.col("_c_type"))
    done = G.completion(F.col("task_completion")).alias("task_completion")
    return derived(j.select(
        *[done if c == "task_completion" else F.col(c) for c in annotated.columns if c not in wanted],
        *wanted.values(),
        F.coalesce("_tok", F.lit(False)).alias("has_tokens"), F.coalesce("_edi", F.lit(False)).alias("has_edit_metrics"),
        F.coalesce("_cls", F.lit(False)).alias("has_classification")))


def join_coverage(enriched: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of every join."""
    return enriched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("has_tokens").alias("token_hits"),
        F.count_if("has_edit_metrics").alias("edit_hits"), F.count_if("has_classification").alias("class_hits"))


def coverage(left: DataFrame, right: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Matched rows and percent of the left side; ``right`` is unique on ``on``."""
    r = right.select(*on).withColumn("_hit", F.lit(1))
    return left.join(r, on, "left").groupBy(*keys).agg(
        F.count("_hit").alias("matched"), F.count(F.lit(1)).alias("total"),
        (F.count("_hit") * 100.0 / F.count(F.lit(1))).alias("pct"))


def reconcile_type(tasks: DataFrame, annotations: DataFrame) -> DataFrame:
    """The annotated type replaces the rule type when its confidence is medium or high."""
    notes = annotations.select("task_id", F.col("task_type").alias("_t"), F.col("task_type_confidence").alias("_c"))
    use = (F.coalesce("_t", F.lit("")) != "") & F.col("_c").isin("medium", "high")
    return tasks.join(notes, "task_id", "left").withColumn(
        "final_type", F.when(use, F.col("_t")).otherwise(F.col("type"))
    ).withColumn("type_source", F.when(use, "annotation").otherwise("rules")).drop("_t", "_c")


def missing_types(annotations: DataFrame, prompts: DataFrame) -> DataFrame:
    """Annotations without a type, with the prompt to classify."""
    return annotations.where(F.coalesce("task_type", F.lit("")) == "").join(prompts, "task_id", "left")


def compat(annotated: DataFrame) -> DataFrame:
    """The 27 columns older readers expect."""
    return annotated.select(
        "task_id", F.col("cohort").alias("model"), "tool_calls", "files_touched", "lines_added", "lines_removed",
        "duration_seconds", "work_category", "execution_quality", "user_sentiment", "sentiment_confidence",
        "follow_up_pattern", "summary", "task_completion", "scope_management", "communication_quality",
        "error_recovery", "iteration_required", "alignment_score", "lines_per_minute", "tools_per_file",
        "autonomy_level", "normalized_execution_quality", "normalized_work_category",
        "normalized_user_sentiment", "task_type", "task_type_confidence")


def type_agreement(df: DataFrame, left: str, right: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Agreement rate with resolved unknowns, and the confusion counts."""
    both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    unknown = F.col(left) == "unknown"
    rate = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(left) == F.col(right)).cast("int")).alias("agreement"),
        F.count_if(unknown).alias("unknown"),
        F.count_if(unknown & (F.col(right) != "unknown")).alias("resolved"))
    confusion = both.groupBy(*keys, left, right).agg(F.count(F.lit(1)).alias("count"))
    return rate, confusion


def signal_agreement_rate(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """A36."""
    same = F.col("signal_agreement.keyword_sentiment") == F.col("signal_agreement.llm_sentiment")
    return annotated.groupBy(*keys).agg(F.avg(same.cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def normalisation_coverage(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Share of free-text fields decided by a pattern instead of the default."""
    from taskloom.functions import patterns as P

    hits = sum((G.vote(F.col(c), v).isNotNull().cast("int") for c, v in (
        ("execution_quality", P.QUALITY_VOTES), ("work_category", P.WORK_VOTES),
        ("user_sentiment", P.SENTIMENT_VOTES))), F.lit(0))
    return raw.groupBy(*keys).agg(ratio0(F.sum(hits), F.count(F.lit(1)) * 3).alias("matched_share"),
                                  F.count(F.lit(1)).alias("n"))
