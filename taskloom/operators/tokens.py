"""Token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import patterns as P
from taskloom.functions.numbers import percent, ratio0
from taskloom.operators import bootstrap as B
from taskloom.operators import ranks as R
from taskloom.operators import scan as S


def expand_groups(tasks: DataFrame, levels: dict[str, str], always: list[str]) -> DataFrame:
    """A6 grouping sets ((always), (always, level_1), ...) as one (grouping, value) pair per set.

    The rows are expanded in the mapper and folded there again by the partial
    aggregate, as GROUPING SETS does, and the same rows can feed rank scans.
    """
    sets = [F.struct(F.lit("overall").alias("grouping"), F.lit("all").alias("group_value"))]
    sets += [F.struct(F.lit(g).alias("grouping"), F.coalesce(F.col(c), F.lit("unknown")).alias("group_value"))
             for g, c in levels.items()]
    rest = [c for c in tasks.columns if c not in always]
    return tasks.select(*always, *rest, F.inline(F.array(*sets)))


def composition(prices: dict[str, float] = P.DEFAULT_PRICE) -> list[Column]:
    """Percent of cost per token class, zeros when nothing was spent."""
    tokens = {"input": "total_input_tokens", "output": "total_output_tokens",
              "cache_read": "cache_read_tokens", "cache_write": "cache_write_tokens"}
    costs = {k: F.sum(c) / 1e6 * prices[k] for k, c in tokens.items()}
    whole = costs["input"] + costs["output"] + costs["cache_read"] + costs["cache_write"]
    return [percent(v, whole).alias(f"{k}_pct") for k, v in costs.items()]


def token_stats(expanded: DataFrame, keys: list[str], prices: dict[str, float] = P.DEFAULT_PRICE) -> DataFrame:
    """A6 without medians and intervals: one partial aggregate per group."""
    n = F.count(F.lit(1))
    used = F.count_if(F.col("thinking_blocks") > 0)
    requests = F.sum("request_count")
    chars = ["tool_use_chars", "edit_content_chars", "write_content_chars", "bash_command_chars",
             "agent_prompt_chars", "search_chars"]
    have = set(expanded.columns)
    return expanded.groupBy(*keys).agg(
        n.alias("count"),
        F.sum("total_input_tokens").alias("total_input_tokens"),
        F.sum("total_output_tokens").alias("total_output_tokens"),
        F.sum("estimated_cost").alias("total_cost_usd"),
        F.avg("total_input_tokens").alias("avg_input_tokens"),
        F.avg("total_output_tokens").alias("avg_output_tokens"),
        F.avg("estimated_cost").alias("avg_cost_usd"),
        F.avg("thinking_chars").alias("avg_thinking_chars"),
        F.avg("text_chars").alias("avg_text_chars"),
        (used / n).alias("thinking_ratio"),
        used.alias("tasks_with_thinking"),
        (F.count_if(F.col("thinking_chars") == 0) / n).alias("thinking_skip_rate"),
        ratio0(F.sum("thinking_chars"), used).alias("avg_thinking_chars_when_used"),
        F.sum(F.floor(F.col("thinking_chars") / 3)).alias("estimated_thinking_tokens"),
        F.sum(F.floor(F.col("text_chars") / 4)).alias("estimated_text_tokens"),
        F.avg("request_count").alias("avg_requests_per_task"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.sum("cache_write_tokens").alias("cache_write_tokens"),
        *composition(prices),
        ratio0(F.sum("total_output_tokens"), requests).alias("avg_output_per_request"),
        ratio0(F.sum("text_chars"), requests).alias("avg_text_chars_per_request"),
        *[F.avg(c).alias(f"avg_{c}") for c in chars if c in have],
    )


def token_report(tasks: DataFrame, levels: dict[str, str], ident: str = "task_id",
                 always: tuple[str, ...] = ("cohort",), prices: dict[str, float] = P.DEFAULT_PRICE) -> DataFrame:
    """Statistics, medians and bootstrap intervals for all groupings."""
    keys = [*always, "grouping", "group_value"]
    expanded = expand_groups(tasks, levels, list(always))
    out = token_stats(expanded, keys, prices)
    for value, name in (("estimated_cost", "cost"), ("total_output_tokens", "output_tokens")):
        out = S.join_keys(out, R.quantiles(expanded, keys, value, {f"median_{name}": 0.5}), keys, "left")
    per_request = tasks.withColumn("_o", ratio0(F.col("total_output_tokens"), F.col("request_count")))
    named = {"cost": "estimated_cost", "output_tokens": "total_output_tokens", "per_request": "_o"}
    finest = list(dict.fromkeys([*always, *levels.values()]))
    found = B.mean_intervals(per_request, finest, list(named.values()), ident, 2000, by_index=True,
                             regroup=(lambda folded: expand_groups(folded, levels, list(always)), keys))
    ends = [F.col(v)[f"ci_{e}"].alias(f"{name}_ci_{e}") for name, v in named.items() for e in ("lower", "upper")]
    return S.join_keys(out, found.select(*keys, *ends), keys, "left")


def thinking_config(marked: DataFrame) -> DataFrame:
    """A5: thinking setting in force when a task starts: the last one seen in the session."""
    setting = F.when(F.col("has_thinking_meta"), F.struct("thinking_disabled", "max_thinking_tokens"))
    seen = S.ordered(marked, ["session_id"], ["msg_index"], S.index_chunk("msg_index"), _cfg=S.latest(setting))
    return seen.where("is_start").select(
        "session_id", "task_n",
        F.coalesce(~F.col("_cfg.thinking_disabled"), F.lit(False)).alias("thinking_enabled"),
        F.coalesce("_cfg.max_thinking_tokens", F.lit(0).cast("long")).alias("max_thinking_tokens"))
