"""The canonical task table.

Blocks are exploded once and folded by (session, task) with algebraic
aggregates only, so a task of any size is combined on the map side. Events that
belong to a task (calls, requests, edits, errors, compactions) are kept as long
tables keyed by (session_id, task_n) instead of arrays inside a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import classify as C
from taskloom.functions import patterns as P
from taskloom.functions import text as T
from taskloom.operators import scan as S
from taskloom.operators import segment as G
from taskloom.sources.stage import stage as write_stage

KEY = ["session_id", "task_n"]


def _get(path: str, kind: str = "string", block: str = "b") -> Column:
    return F.try_variant_get(F.col(block), path, kind)


def _text(path: str) -> Column:
    return F.coalesce(_get(path), F.lit(""))


def explode_blocks(marked: DataFrame) -> DataFrame:
    """One row per content block, one row with a null block for messages without any."""
    return marked.where("task_n > 0").select(
        "session_id", "task_n", "msg_index", "type", "ts", "ts_raw", "request_id",
        F.posexplode_outer("blocks").alias("pos", "b"),
    ).withColumn("kind", _get("$.type"))


def tool_calls(blocks: DataFrame) -> DataFrame:
    """One row per tool call with its measures."""
    name = F.coalesce(_get("$.name"), F.lit("unknown"))
    old, new = _text("$.input.old_string"), _text("$.input.new_string")
    content, command = _text("$.input.content"), _text("$.input.command")
    pattern = _text("$.input.pattern")
    values = F.map_values(_get("$.input", "map<string,variant>"))
    chars = F.aggregate(
        values, F.lit(0).cast("long"),
        lambda acc, v: acc + F.coalesce(F.length(v.cast("string")), F.lit(0)).cast("long"),
    )
    files = name.isin("Read", "Write", "Edit")
    return blocks.where("type = 'assistant' and kind = 'tool_use'").select(
        "session_id", "task_n", "msg_index", "pos", "ts", "request_id",
        _text("$.id").alias("tool_use_id"),
        name.alias("name"),
        F.when(files, _text("$.input.file_path")).otherwise("").alias("file"),
        F.when(name == "Write", T.line_count(content)).when(name == "Edit", T.line_count(new))
        .otherwise(0).alias("lines_added"),
        F.when(name == "Edit", T.line_count(old)).otherwise(0).alias("lines_removed"),
        F.when(name == "Bash", command).otherwise("").alias("command"),
        F.when(name.isin("Grep", "Glob"), pattern).otherwise("").alias("pattern"),
        F.coalesce(chars, F.lit(0)).alias("input_chars"),
        F.when(name == "Edit", F.length(old) + F.length(new)).otherwise(0).alias("edit_chars"),
        F.when(name.isin("Write", "NotebookEdit"),
               F.length(F.coalesce(F.nullif(content, F.lit("")), _text("$.input.new_source"))))
        .otherwise(0).alias("write_chars"),
        F.when(name == "Bash", F.length(command)).otherwise(0).alias("bash_chars"),
        F.when(name == "Task", F.length(_text("$.input.prompt"))).otherwise(0).alias("agent_chars"),
        F.when(name.isin("Grep", "Glob"), F.length(pattern) + F.length(_text("$.input.path")))
        .otherwise(0).alias("search_chars"),
        F.when(name == "Task", F.coalesce(_get("$.input.subagent_type"), F.lit("unknown"))).alias("subagent_type"),
        (name.isin("Bash", "Task") & F.coalesce(_get("$.input.run_in_background", "boolean"), F.lit(False)))
        .alias("in_background"),
        old.alias("old_string"), new.alias("new_string"),
        F.coalesce(_get("$.input.replace_all", "boolean"), F.lit(False)).alias("replace_all"),
    )


def tool_results(blocks: DataFrame) -> DataFrame:
    """One row per tool result with its text and error flags."""
    parts = F.transform(
        F.filter(_get("$.content", "array<variant>"),
                 lambda r: F.try_variant_get(r, "$.type", "string") == "text"),
        lambda r: F.coalesce(F.try_variant_get(r, "$.text", "string"), F.lit("")),
    )
    return blocks.where("type = 'user' and kind = 'tool_result'").select(
        "session_id", "task_n", "msg_index",
        _text("$.tool_use_id").alias("tool_use_id"),
        F.coalesce(_get("$.is_error", "boolean"), F.lit(False)).alias("is_tool_error"),
        F.coalesce(F.array_join(parts, ""), _text("$.content")).alias("text"),
    )


def errors(results: DataFrame) -> DataFrame:
    """Tool results that failed or read like an error."""
    return results.where(
        F.col("is_tool_error") | ((F.length("text") > 0) & C.looks_like_error(F.col("text")))
    ).select(*KEY, "msg_index", "text", "is_tool_error")


def edit_events(calls: DataFrame, results: DataFrame, keep_content: bool = False) -> DataFrame:
    """Edit calls matched to their first later result.

    The event belongs to the task open when the result arrived. Calls without a
    result are dropped. Strings are kept whole.
    """
    is_edit = F.col("name") == "Edit"
    uses = calls.where(F.col("name").isin("Edit", "Write") & (F.col("file") != "")).select(
        "session_id", "tool_use_id", F.col("name").alias("tool_name"), F.col("file").alias("file_path"),
        F.when(is_edit, F.col("old_string")).otherwise("").alias("old_string"),
        F.when(is_edit, F.col("new_string")).otherwise("").alias("new_string"),
        (is_edit & F.col("replace_all")).alias("replace_all"),
        "msg_index", "pos", "ts",
    )
    done = results.select(
        "session_id", "tool_use_id", F.col("task_n").alias("result_task"),
        F.col("msg_index").alias("result_index"), "is_tool_error",
    )
    matched = uses.join(done, ["session_id", "tool_use_id"]).where("result_index > msg_index")
    event = [c for c in uses.columns if c not in ("session_id", "tool_use_id")]
    return matched.groupBy("session_id", "tool_use_id", "msg_index", "pos").agg(
        *[F.first(c).alias(c) for c in event if c not in ("msg_index", "pos")],
        F.min_by("result_task", "result_index").alias("task_n"),
        F.min_by(~F.col("is_tool_error"), "result_index").alias("succeeded"),
    )


def requests(marked: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row per (task, request).

    Input and cache counters come from the first message of the request, output
    tokens are the maximum of a cumulative counter.
    """
    mine = marked.where("task_n > 0 and type = 'assistant' and request_id is not null")
    table = mine.groupBy(*KEY, "request_id").agg(
        F.min_by(F.struct("input_tokens", "cache_read", "cache_write", "ts"), "msg_index").alias("head"),
        F.max("output_tokens").alias("output_tokens"),
        F.max_by("ts", "msg_index").alias("last_ts"),
        F.min("msg_index").alias("first_index"),
    ).select(
        *KEY, "request_id", "first_index",
        F.col("head.input_tokens").alias("input_tokens"),
        F.col("head.cache_read").alias("cache_read"),
        F.col("head.cache_write").alias("cache_write"),
        "output_tokens", F.col("head.ts").alias("first_ts"), "last_ts",
    )
    if calls is None:
        return table
    counts = calls.where("request_id is not null").groupBy(*KEY, "request_id").agg(
        F.count(F.lit(1)).alias("tool_count")
    )
    return table.join(counts, [*KEY, "request_id"], "left").withColumn(
        "tool_count", F.coalesce("tool_count", F.lit(0))
    ).withColumn("has_tool_use", F.col("tool_count") > 0)


def compactions(messages_marked: DataFrame) -> DataFrame:
    """Boundary events; one before the first task goes to task 1."""
    return messages_marked.where("type = 'system' and subtype = 'compact_boundary'").select(
        "session_id", F.greatest("task_n", F.lit(1).cast("long")).alias("task_n"),
        F.col("compact_trigger").alias("trigger"), F.col("compact_pre_tokens").alias("pre_tokens"),
        "msg_index", "ts",
    )


def tool_sequence(calls: DataFrame, keys: list[str] = KEY, order: tuple[str, str] = ("msg_index", "pos"),
                  chunk: Column | None = None, first: int = 10, arrow: str = "→") -> DataFrame:
    """Names with repeats collapsed, the first ten joined by an arrow.

    Only ``first`` names per task reach the collecting aggregate.
    """
    chunk = S.index_chunk("msg_index") if chunk is None else chunk
    changed = S.ordered(calls, keys, list(order), chunk, _prev=S.latest_before(F.col("name"))).where(
        F.col("_prev").isNull() | (F.col("_prev") != F.col("name"))
    )
    nth = S.ordered(changed, keys, list(order), chunk, _nth=S.position()).where(F.col("_nth") <= first)
    return nth.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_nth", "name"))), lambda s: s["name"]), arrow
        ).alias("tool_sequence")
    )


def cost(prices: dict[str, float] = P.DEFAULT_PRICE) -> Column:
    """A4: dollars, rounded to 4 places at the end."""
    per = {"input": "input_tokens", "output": "output_tokens",
           "cache_read": "cache_read_tokens", "cache_write": "cache_write_tokens"}
    total = F.lit(0.0)
    for kind, column in per.items():
        total = total + F.coalesce(F.col(column), F.lit(0)) / 1e6 * prices[kind]
    return F.round(total, 4)


def priced(tasks: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """A4 with a price table (cohort, input, output, cache_read, cache_write) and a fallback price."""
    if prices is None:
        return tasks.withColumn("estimated_cost", cost())
    p = prices.select("cohort", *[F.col(k).alias(f"_p_{k}") for k in P.DEFAULT_PRICE])
    joined = tasks.join(p, "cohort", "left")
    total = F.lit(0.0)
    for kind, fallback in P.DEFAULT_PRICE.items():
        tokens = F.coalesce(F.col(f"{kind}_tokens"), F.lit(0))
        total = total + tokens / 1e6 * F.coalesce(F.col(f"_p_{kind}"), F.lit(fallback))
    return joined.withColumn("estimated_cost", F.round(total, 4)).drop(*[f"_p_{k}" for k in P.DEFAULT_PRICE])


SUMMED = [
    "tool_count", "total_lines_added", "total_lines_removed", "thinking_chars", "thinking_blocks",
    "text_chars", "text_blocks", "tool_use_blocks", "tool_use_chars", "edit_content_chars",
    "write_content_chars", "bash_command_chars", "agent_prompt_chars", "search_chars", "subagent_count",
    "run_in_background_count", "read_calls", "write_calls", "edit_calls", "general_purpose_agents",
    "messages_with_tools", "parallel_tool_messages", "turn_duration_ms", "request_count", "input_tokens",
    "output_tokens", "cache_read_tokens", "cache_write_tokens", "compaction_count", "error_count",
    "edit_event_count", "failed_edit_count",
] + [f"domain_{d}" for d in P.DOMAINS]


def _block_measures(blocks: DataFrame) -> DataFrame:
    mine = F.col("type") == "assistant"
    def chars(kind: str, path: str) -> Column:
        return F.sum(F.when(mine & (F.col("kind") == kind), F.length(_text(path))).otherwise(0))
    def count(kind: str) -> Column:
        return F.count_if(mine & (F.col("kind") == kind))
    return blocks.groupBy(*KEY).agg(
        chars("thinking", "$.thinking").alias("thinking_chars"),
        count("thinking").alias("thinking_blocks"),
        chars("text", "$.text").alias("text_chars"),
        count("text").alias("text_blocks"),
        count("tool_use").alias("tool_use_blocks"),
    )


def _call_measures(calls: DataFrame) -> DataFrame:
    def total(c: str) -> Column:
        return F.sum(c).cast("long")
    per_message = calls.groupBy(*KEY, "msg_index").agg(
        F.count(F.lit(1)).alias("tool_count"),
        total("lines_added").alias("total_lines_added"),
        total("lines_removed").alias("total_lines_removed"),
        total("input_chars").alias("tool_use_chars"),
        total("edit_chars").alias("edit_content_chars"),
        total("write_chars").alias("write_content_chars"),
        total("bash_chars").alias("bash_command_chars"),
        total("agent_chars").alias("agent_prompt_chars"),
        total("search_chars").alias("search_chars"),
        F.count_if(F.col("name") == "Task").alias("subagent_count"),
        F.count_if("in_background").alias("run_in_background_count"),
        F.count_if(F.col("name") == "Read").alias("read_calls"),
        F.count_if(F.col("name") == "Write").alias("write_calls"),
        F.count_if(F.col("name") == "Edit").alias("edit_calls"),
        F.count_if(F.col("subagent_type") == "general-purpose").alias("general_purpose_agents"),
        F.bool_or(F.col("name") == "EnterPlanMode").alias("used_planning"),
        *[F.count_if((F.col("file") != "") & hit).alias(f"domain_{d}")
          for d, hit in C.domain_hits(F.col("file")).items()],
    )
    sums = [c for c in per_message.columns if c not in (*KEY, "msg_index", "used_planning")]
    return per_message.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.bool_or("used_planning").alias("used_planning"),
        F.count(F.lit(1)).alias("messages_with_tools"),
        F.count_if(F.col("tool_count") > 1).alias("parallel_tool_messages"),
    )


def _message_measures(marked: DataFrame) -> DataFrame:
    """W4, W11."""
    assistant = F.col("type") == "assistant"
    return marked.where("task_n > 0").groupBy(*KEY).agg(
        F.min(F.when(F.col("is_start"), F.col("ts"))).alias("start_ts"),
        F.max_by(F.col("ts"), F.when(assistant & F.col("ts").isNotNull(), F.col("msg_index"))).alias("end_ts"),
        F.sum(F.when((F.col("type") == "system") & (F.col("subtype") == "turn_duration")
                     & (F.col("duration_ms") > 0), F.col("duration_ms")).otherwise(0)).alias("turn_duration_ms"),
    )


@dataclass
class TaskTables:
    """The task table and the long event tables that belong to it."""

    tasks: DataFrame
    calls: DataFrame
    requests: DataFrame
    edits: DataFrame
    errors: DataFrame
    compactions: DataFrame


def exclude_reason(prompt: Column, outcome: Column, tools: Column, seconds: Column) -> Column:
    """First cleaning rule that applies, '' when the task is kept."""
    p = T.stripped(prompt)
    bare = F.rtrim(F.lower(p), F.lit("."))
    return (
        F.when(T.matches(p, P.SLASH_COMMAND), "slash_command")
        .when((outcome == "system_continuation") | T.is_generated(p), "system_continuation")
        .when(bare.isin(P.BARE_ACKS) & (tools == 0) & (seconds < 5), "empty_continuation")
        .when((tools == 0) & (seconds == 0) & (outcome == "session_end"), "no_response_interrupt")
        .otherwise("")
    )


def task_flags(prompt: Column, is_meta: Column, project: Column, compactions_before: Column,
               reason: Column, home_project: str = "") -> Column:
    """Informational flags of kept tasks."""
    found = F.array_compact(F.array(
        F.when(is_meta, "meta"),
        F.when(F.coalesce(project, F.lit("")).isin("", home_project), "no_project"),
        F.when(prompt.contains("[Request interrupted"), "interrupted"),
        F.when(compactions_before > 0, "post_compaction"),
    ))
    return F.when(reason == "", found).otherwise(F.array().cast("array<string>"))


def build(messages: DataFrame, meta_project: str | None = None, home_project: str = "",
          stage=write_stage) -> TaskTables:
    """A2, A3, A5: canonical tasks before plan merging, plus their event tables.

    Tables that several branches read (marked messages, calls, results) are
    written once as stages.
    """
    marked = stage(G.mark_tasks(messages), "marked")
    blocks = explode_blocks(marked)
    calls = stage(tool_calls(blocks), "calls")
    results = stage(tool_results(blocks), "results")
    edits = edit_events(calls, results)
    bad = errors(results)
    reqs = requests(marked, calls)
    comp = compactions(marked)

    starts = G.with_outcome(G.task_starts(marked)).select(
        "task_id", *KEY, "project_path", "prompt", "msg_index_start", "msg_index_end",
        "next_user_message", "outcome_category", "outcome_evidence",
    )
    per_request = reqs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read").alias("cache_read_tokens"),
        F.sum("cache_write").alias("cache_write_tokens"),
    )
    extra = [
        _message_measures(marked), _block_measures(blocks), _call_measures(calls), per_request,
        comp.groupBy(*KEY).agg(F.count(F.lit(1)).alias("compaction_count")),
        bad.groupBy(*KEY).agg(F.count(F.lit(1)).alias("error_count")),
        edits.groupBy(*KEY).agg(
            F.count_if("succeeded").alias("edit_event_count"),
            F.count_if(~F.col("succeeded")).alias("failed_edit_count"),
        ),
    ]
    wide = starts
    for part in extra:
        wide = wide.join(part, KEY, "left")
    wide = wide.na.fill(0, SUMMED).na.fill(False, ["used_planning"])
    project = F.col("project_path")
    meta = project.contains(meta_project) if meta_project else F.lit(False)
    tasks = (
        wide.withColumn("duration_seconds", F.coalesce(S.seconds_between("start_ts", "end_ts"), F.lit(0.0)))
        .withColumn("user_prompt", F.col("prompt"))
        .withColumn("is_meta", F.coalesce(meta, F.lit(False)))
        .withColumn("exclude_reason", exclude_reason(
            F.col("user_prompt"), F.col("outcome_category"), F.col("tool_count"), F.col("duration_seconds")))
        .withColumn("flags", task_flags(
            F.col("user_prompt"), F.col("is_meta"), project, F.col("compaction_count"),
            F.col("exclude_reason"), home_project))
    )
    return TaskTables(tasks, calls, reqs, edits, bad, comp)


# --- W12: plan continuations -------------------------------------------------
def plan_roots(tasks: DataFrame, chunk_size: int = 4096) -> DataFrame:
    """(session_id, task_n) -> root_n for every task.

    Tasks between two ordinary tasks form an island. Its root is the ordinary
    task in front if that one planned and is kept, else the first plan of the
    island. Every plan joins the root, and so does every interrupt that is
    followed by a plan in the same island. A promoted plan is the parent of the
    later plans of its island, so chains need no iteration.
    """
    prompt = T.stripped(F.col("user_prompt"))
    typed = tasks.select(
        *KEY, "msg_index_start",
        T.matches(prompt, P.PLAN_PROMPT).alias("is_plan"),
        T.matches(prompt, P.INTERRUPT_PROMPT).alias("is_interrupt"),
        (F.col("used_planning") & (F.col("exclude_reason") == "")).alias("can_parent"),
    ).withColumn("is_real", ~F.col("is_plan") & ~F.col("is_interrupt"))
    chunk = S.index_chunk("msg_index_start", chunk_size)
    walked = S.ordered(
        typed, ["session_id"], ["msg_index_start"], chunk,
        island=S.total(F.col("is_real").cast("long")),
        front=S.latest(F.when(F.col("is_real"), F.struct("task_n", "can_parent"))),
        next_plan=S.next_after(F.when(F.col("is_plan"), F.col("msg_index_start"))),
        next_real=S.next_after(F.when(F.col("is_real"), F.col("msg_index_start"))),
    )
    first_plan = walked.where("is_plan").groupBy("session_id", "island").agg(F.min("task_n").alias("first_plan"))
    follows = F.col("next_plan").isNotNull() & (
        F.col("next_real").isNull() | (F.col("next_plan") < F.col("next_real"))
    )
    moves = F.col("is_plan") | (F.col("is_interrupt") & follows)
    root = F.when(F.coalesce(F.col("front.can_parent"), F.lit(False)), F.col("front.task_n")).otherwise(
        F.col("first_plan")
    )
    return walked.join(first_plan, ["session_id", "island"], "left").select(
        *KEY, F.when(moves, root).otherwise(F.col("task_n")).alias("root_n"),
        (moves & (root == F.col("task_n"))).alias("promoted"),
    )


def move_to_root(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Reassign an event table to the merged tasks; only moved tasks are joined."""
    moved = roots.where("root_n <> task_n").select(*KEY, "root_n")
    return events.join(moved, KEY, "left").withColumn("task_n", F.coalesce("root_n", "task_n")).drop("root_n")


def merge_plans(tables: TaskTables, roots: DataFrame) -> TaskTables:
    """Fold absorbed tasks into their root and drop them."""
    is_root = F.col("task_n") == F.col("root_n")
    identity = [
        "task_id", "project_path", "prompt", "user_prompt", "msg_index_start", "next_user_message",
        "outcome_category", "outcome_evidence", "is_meta", "exclude_reason", "flags", "promoted",
        "duration_seconds",
    ]
    merged = tables.tasks.join(roots, KEY).groupBy("session_id", "root_n").agg(
        F.max(F.when(is_root, F.struct(*identity))).alias("me"),
        *[F.sum(c).alias(c) for c in SUMMED],
        F.bool_or("used_planning").alias("used_planning"),
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.max("msg_index_end").alias("msg_index_end"),
        F.count(F.lit(1)).alias("_members"),
        F.array_distinct(F.flatten(F.array(
            F.max(F.when(is_root, F.col("flags"))),
            *[F.max(F.when(F.array_contains("flags", f), F.array(F.lit(f))).otherwise(F.array().cast("array<string>")))
              for f in ("meta", "no_project", "interrupted", "post_compaction")],
        ))).alias("flags"),
    )
    promoted = F.coalesce(F.col("me.promoted"), F.lit(False))
    tasks = merged.select(
        F.col("session_id"), F.col("root_n").alias("task_n"),
        *[F.col(f"me.{c}").alias(c) for c in identity
          if c not in ("promoted", "exclude_reason", "flags", "duration_seconds")],
        F.when(promoted, "").otherwise(F.col("me.exclude_reason")).alias("exclude_reason"),
        "flags", *SUMMED,
        (F.col("used_planning") | promoted).alias("used_planning"),
        "start_ts", "end_ts", "msg_index_end",
        F.when(F.col("_members") > 1, F.coalesce(S.seconds_between("start_ts", "end_ts"), F.lit(0.0)))
        .otherwise(F.col("me.duration_seconds")).alias("duration_seconds"),
    )
    return TaskTables(
        tasks,
        *[move_to_root(t, roots) for t in
          (tables.calls, tables.requests, tables.edits, tables.errors, tables.compactions)],
    )


def finish(tables: TaskTables, prices: DataFrame | None = None) -> TaskTables:
    """U4, W6, P21, A4 and C3-C6 on merged tasks."""
    paths = tables.calls.where("file <> ''").select(*KEY, "file").distinct()
    touched = paths.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_files_touched"))
    tasks = tables.tasks.join(touched, KEY, "left").join(tool_sequence(tables.calls), KEY, "left")
    tasks = tasks.na.fill(0, ["total_files_touched"]).na.fill("", ["tool_sequence"])
    tasks = priced(tasks, prices).withColumn("used_subagents", F.col("subagent_count") > 0)
    tasks = tasks.withColumn(
        "task_summary", T.task_summary(F.col("user_prompt"), F.col("tool_count"), F.col("total_files_touched"))
    )
    lines = F.col("total_lines_added") + F.col("total_lines_removed")
    args = (F.col("user_prompt"), F.col("tool_count"), F.col("total_files_touched"), lines)
    types, signals = C.task_types(args[0]), C.type_signals(args[0])
    tasks = tasks.withColumn("classification", F.struct(
        types[0].alias("type"),
        F.slice(types, 2, len(P.TYPE_NAMES)).alias("secondary_types"),
        C.complexity(*args[1:]).alias("complexity"),
        C.domain_from_counts({d: F.col(f"domain_{d}") for d in P.DOMAINS}).alias("domain"),
        C.confidence(F.size(signals), types[0]).alias("confidence"),
        F.concat(signals, C.complexity_signals(*args)).alias("signals"),
    ))
    return TaskTables(tasks, tables.calls, tables.requests, tables.edits, tables.errors, tables.compactions)


def canonical(messages: DataFrame, prices: DataFrame | None = None, **options) -> TaskTables:
    """Messages to merged, priced and classified tasks.

    Cleaning runs before merging: the merge reads the exclusion of the parent
    and clears it on promotion.
    """
    stage = options.get("stage", write_stage)
    tables = build(messages, **options)
    tables.tasks = stage(tables.tasks, "tasks")
    tables.edits = stage(tables.edits, "edits")
    roots = stage(plan_roots(tables.tasks), "roots")
    done = finish(merge_plans(tables, roots), prices)
    done.tasks = stage(done.tasks, "canonical")
    return done


def nested(tables: TaskTables) -> DataFrame:
    """The wide row with arrays, for publication of ordinary-sized tasks.

    Each array holds the events of one task, so this is the one place where a
    task has to fit in a row. Analyses read the long tables instead.
    """
    def arr(df: DataFrame, name: str, order: list[str], cols: list[str]) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order])))
        return df.groupBy(*KEY).agg(packed.alias(name))

    tasks = tables.tasks
    for part in (
        arr(tables.calls, "tool_calls", ["msg_index", "pos"],
            ["name", "file", "lines_added", "lines_removed", "command", "pattern", "ts", "tool_use_id"]),
        arr(tables.edits, "edit_events", ["msg_index", "pos"],
            ["tool_use_id", "tool_name", "file_path", "old_string", "new_string", "replace_all", "succeeded", "ts"]),
        arr(tables.requests, "request_timings", ["first_index"],
            ["request_id", "first_ts", "last_ts", "has_tool_use", "tool_count"]),
        arr(tables.compactions, "compaction_events_before", ["msg_index"], ["trigger", "pre_tokens", "ts"]),
        arr(tables.errors, "errors", ["msg_index"], ["text", "is_tool_error"]),
    ):
        tasks = tasks.join(part, KEY, "left")
    return tasks
