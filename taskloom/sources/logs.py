"""Session logs: one JSON message per line."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions import text as T
from taskloom.operators import scan as S


def _path(encoded: Column) -> Column:
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, paths: str | list[str], exclude_projects: Iterable[str] = ()) -> DataFrame:
    """Every line of every session file under ``paths``.

    Large files are split over tasks. The order of lines inside a file is
    (start of the split, row id inside the split), so no file has to fit in one
    task.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(paths)
        .select(
            F.col("value"),
            _path(F.col("_metadata.file_path")).alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        .withColumn("session_id", F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1))
        .withColumn("project_path", F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1))
        .where(~F.col("session_id").startswith("agent-"))
    )
    for part in exclude_projects:
        lines = lines.where(~F.col("project_path").contains(part))
    return lines


def number_messages(lines: DataFrame) -> DataFrame:
    """Drop blank and undecodable lines, number the rest from 0 within the session."""
    parsed = lines.withColumn("doc", F.try_parse_json(T.stripped(F.col("value")))).where(
        F.col("doc").isNotNull()
    )
    numbered = S.ordered(parsed, ["session_id"], ["block", "line"], F.col("block"), nth=S.position())
    return numbered.select(
        "session_id", "project_path", "file_path", (F.col("nth") - 1).alias("msg_index"), "doc"
    )


def _get(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def _long(doc: Column, path: str) -> Column:
    return F.coalesce(_get(doc, path, "long"), F.lit(0).cast("long"))


def user_text(content: Column, blocks: Column) -> Column:
    """The string itself, or text blocks and bare strings joined by one space."""
    piece = F.transform(
        blocks,
        lambda b: F.when(F.schema_of_variant(b) == "STRING", b.cast("string")).when(
            _get(b, "$.type", "string") == "text", F.coalesce(_get(b, "$.text", "string"), F.lit(""))
        ),
    )
    return F.when(blocks.isNotNull(), F.array_join(F.array_compact(piece), " ")).otherwise(
        F.coalesce(content, F.lit(""))
    )


def parse_messages(numbered: DataFrame, add_nested_cache: bool = False) -> DataFrame:
    """Typed message table; the content stays an array of VARIANT blocks.

    ``add_nested_cache`` adds the nested cache-creation counters on top of the
    total, which may already contain them (P6).
    """
    d = F.col("doc")
    usage = "$.message.usage"
    write = _long(d, f"{usage}.cache_creation_input_tokens")
    if add_nested_cache:
        write = (
            write
            + _long(d, f"{usage}.cache_creation.ephemeral_5m_input_tokens")
            + _long(d, f"{usage}.cache_creation.ephemeral_1h_input_tokens")
        )
    blocks = _get(d, "$.message.content", "array<variant>")
    return numbered.select(
        "session_id", "project_path", "file_path", "msg_index",
        _get(d, "$.type", "string").alias("type"),
        _get(d, "$.subtype", "string").alias("subtype"),
        _get(d, "$.timestamp", "string").alias("ts_raw"),
        F.try_to_timestamp(_get(d, "$.timestamp", "string")).alias("ts"),
        F.nullif(_get(d, "$.requestId", "string"), F.lit("")).alias("request_id"),
        F.nullif(_get(d, "$.message.model", "string"), F.lit("")).alias("model"),
        blocks.alias("blocks"),
        user_text(F.when(blocks.isNull(), _get(d, "$.message.content", "string")), blocks).alias("user_text"),
        F.coalesce(
            F.exists(blocks, lambda b: _get(b, "$.type", "string") == "tool_result"), F.lit(False)
        ).alias("is_tool_result"),
        _long(d, f"{usage}.input_tokens").alias("input_tokens"),
        _long(d, f"{usage}.output_tokens").alias("output_tokens"),
        _long(d, f"{usage}.cache_read_input_tokens").alias("cache_read"),
        write.alias("cache_write"),
        _long(d, "$.durationMs").alias("duration_ms"),
        F.coalesce(_get(d, "$.compactMetadata.trigger", "string"), F.lit("unknown")).alias("compact_trigger"),
        _long(d, "$.compactMetadata.preTokens").alias("compact_pre_tokens"),
        (_get(d, "$.thinkingMetadata", "variant").isNotNull()).alias("has_thinking_meta"),
        F.coalesce(_get(d, "$.thinkingMetadata.disabled", "boolean"), F.lit(False)).alias("thinking_disabled"),
        _long(d, "$.thinkingMetadata.maxThinkingTokens").alias("max_thinking_tokens"),
    )


def read_messages(spark: SparkSession, paths: str | list[str], exclude_projects: Iterable[str] = (),
                  add_nested_cache: bool = False) -> DataFrame:
    """S1 + S2 in one call."""
    return parse_messages(number_messages(read_lines(spark, paths, exclude_projects)), add_nested_cache)


def tool_counts_of_log(messages: DataFrame) -> DataFrame:
    """Tools by name and message count per session log."""
    names = messages.where(F.col("type") == "assistant").select(
        "session_id",
        F.explode(F.filter("blocks", lambda b: _get(b, "$.type", "string") == "tool_use")).alias("b"),
    )
    by_name = names.groupBy(
        "session_id", F.coalesce(_get(F.col("b"), "$.name", "string"), F.lit("unknown")).alias("tool")
    ).agg(F.count(F.lit(1)).alias("calls"))
    sizes = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    return sizes.join(by_name, "session_id", "left")
