"""Registered queries over session logs: the JSON lines of ``bindings.conversation_lines``, parsed as VARIANT."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.functions import patterns as P
from taskloom.operators import tasks as TK
from taskloom.plans.bindings import conversation_lines
from taskloom.plans.registry import query, quoted, tidy
from taskloom.sources import logs

LOG = """m as (select conv_id::varchar as session_id, conv_id as c, turn as t, role, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn) - 1 as msg_index,
        (conv_id + turn // 2) % 3 as u, (conv_id + turn) % 3 as w, conv_id || '-' || turn as id from conversations)"""
LINES = "case when length(x) = 0 then 0 else length(x) - length(replace(x, chr(10), '')) + 1 end"


def messages(spark, folder):
    return logs.parse_messages(logs.number_messages(conversation_lines(spark, folder)))


def blocks(spark, folder):
    """Content blocks; a whole session is one task here."""
    return TK.explode_blocks(messages(spark, folder).withColumn("task_n", F.lit(1).cast("long")))


@query("log_messages", f"""with {LOG} select session_id, msg_index::bigint as msg_index, role as type, role = 'user' and u = 2 as is_tool_result,
    case when role = 'system' or role = 'user' and u = 2 then '' when role = 'user' and u = 1 then x || ' and more' else x end as user_text,
    case when role = 'assistant' then c || '-' || (t // 4) end as request_id, case when role = 'assistant' then length(x) else 0 end::bigint as input_tokens,
    case when role = 'assistant' then 2 * t else 0 end::bigint as output_tokens, case when role = 'assistant' then c else 0 end::bigint as cache_read,
    case when role = 'assistant' then 7 else 0 end::bigint as cache_write from m""")
def log_messages(spark, folder):
    """Blank and broken lines dropped, the others numbered and typed."""
    return tidy(messages(spark, folder).select(
        "session_id", "msg_index", "type", "is_tool_result", "user_text", "request_id", "input_tokens", "output_tokens", "cache_read", "cache_write"))


@query("log_calls", f"""with {LOG} select session_id, msg_index::bigint as msg_index, id as tool_use_id, case w when 0 then 'Edit' when 1 then 'Bash' else 'Grep' end as name,
    case when w = 0 then 'f' || t else '' end as file, case when w = 0 then case when length(x) = 0 then 2 else 2 * ({LINES}) end else 0 end::bigint as lines_added,
    case when w = 0 then {LINES} else 0 end::bigint as lines_removed, case when w = 1 then x else '' end as command, case when w = 2 then x else '' end as pattern,
    case w when 0 then 3 * length(x) + 1 + length('f' || t) + case when c % 5 = 0 then 4 else 5 end when 1 then length(x) + case when c % 2 = 0 then 4 else 5 end else length(x) + 3 end::bigint as input_chars,
    case when w = 0 then 3 * length(x) + 1 else 0 end::bigint as edit_chars, case when w = 1 then length(x) else 0 end::bigint as bash_chars,
    case when w = 2 then length(x) + 3 else 0 end::bigint as search_chars, w = 1 and c % 2 = 0 as in_background, w = 0 and c % 5 = 0 as replace_all from m where role = 'assistant'""")
def log_calls(spark, folder):
    """Tool calls with the sizes of their inputs."""
    return tidy(TK.tool_calls(blocks(spark, folder)).select(
        "session_id", "msg_index", "tool_use_id", "name", "file", "lines_added", "lines_removed", "command", "pattern", "input_chars", "edit_chars", "bash_chars",
        "search_chars", "in_background", "replace_all"))


@query("log_errors", f"""with {LOG} select session_id, msg_index::bigint as msg_index, x as text, c % 2 = 0 as is_tool_error from m
    where role = 'user' and u = 2 and (c % 2 = 0 or regexp_matches(x, {quoted('(?i)(?:' + '|'.join(P.ERROR_TEXT) + ')')}))""")
def log_errors(spark, folder):
    """Results that failed or read like an error."""
    return tidy(TK.errors(TK.tool_results(blocks(spark, folder))).select("session_id", "msg_index", "text", "is_tool_error"))


@query("log_edit_events", f"""with {LOG} select a.session_id, a.msg_index::bigint as msg_index, 'f' || a.t as file_path, a.x as old_string, a.x || chr(10) || a.x as new_string,
    a.c % 5 = 0 as replace_all, a.c % 2 = 1 as succeeded from m a join m b on a.c = b.c and b.t = a.t + 1 and a.role = 'assistant' and a.w = 0 and b.role = 'user' and b.u = 2""")
def log_edit_events(spark, folder):
    """Edits matched to their results, whole strings."""
    parts = blocks(spark, folder)
    return tidy(TK.edit_events(TK.tool_calls(parts), TK.tool_results(parts)).select(
        "session_id", "msg_index", "file_path", "old_string", "new_string", "replace_all", "succeeded"))


@query("log_requests", f"""with {LOG}, a as (select *, c || '-' || (t // 4) as request_id from m where role = 'assistant')
    select session_id, request_id, min(msg_index)::bigint as first_index, arg_min(length(x), msg_index)::bigint as input_tokens, max(c)::bigint as cache_read,
           7::bigint as cache_write, max(2 * t)::bigint as output_tokens, count(*)::bigint as tool_count, true as has_tool_use from a group by all""")
def log_requests(spark, folder):
    """Requests with the counters of their first message and the greatest output count."""
    marked = messages(spark, folder).withColumn("task_n", F.lit(1).cast("long"))
    found = TK.requests(marked, TK.tool_calls(TK.explode_blocks(marked)))
    return tidy(found.select("session_id", "request_id", "first_index", "input_tokens", "cache_read", "cache_write", "output_tokens", "tool_count", "has_tool_use"))


@query("log_compactions", f"""with {LOG} select session_id, 1::bigint as task_n, 'auto' as trigger, length(x)::bigint as pre_tokens, msg_index::bigint as msg_index from m where role = 'system'""")
def log_compactions(spark, folder):
    """A boundary before the first task belongs to task 1."""
    marked = messages(spark, folder).withColumn("task_n", F.lit(0).cast("long"))
    return tidy(TK.compactions(marked).select("session_id", "task_n", "trigger", "pre_tokens", "msg_index"))


@query("log_tool_counts", f"""with {LOG}, n as (select session_id, count(*)::bigint as message_count from m group by all),
    k as (select session_id, case w when 0 then 'Edit' when 1 then 'Bash' else 'Grep' end as tool, count(*)::bigint as calls from m where role = 'assistant' group by all)
    select n.session_id, message_count, tool, calls from n left join k using (session_id)""")
def log_tool_counts(spark, folder):
    """Tools and messages of a log."""
    return tidy(logs.tool_counts_of_log(messages(spark, folder)).select("session_id", "message_count", "tool", "calls"))
