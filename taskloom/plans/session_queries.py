"""Queries over the message log and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.functions import outcome as O
from taskloom.functions import patterns as P
from taskloom.functions import text as T
from taskloom.operators import behavior as BH
from taskloom.operators import browse
from taskloom.operators import dataset as D
from taskloom.operators import intervals as I
from taskloom.operators import ranks as R
from taskloom.operators import scan as S
from taskloom.operators import segment as G
from taskloom.operators import tasks as TK
from taskloom.operators import timing as TM
from taskloom.plans import bindings as B
from taskloom.plans.registry import BLANK, NW, any_hit, hit, query, quoted, tidy

# --- message log --------------------------------------------------------------
SKIP = "|".join(p.replace("^", "") for p in P.SKIP_TAGS)
BASIC = "|".join(p.replace("^", "") for p in P.BASIC_SKIP_TAGS)


def marked_sql(skip: str = SKIP) -> str:
    return f"""
    m as (select conv_id::varchar as session_id, conv_id, turn as msg_index, role, text,
                 case when conv_id % 2 = 0 then 'a' else 'b' end as cohort, trim(text, {BLANK}) as t
          from conversations),
    f as (select *, (role = 'user' and not regexp_matches(t, {quoted('^(?:' + skip + ')')}))::int as is_start from m),
    g as (select *, sum(is_start) over (partition by session_id order by msg_index)::bigint as task_n,
                 max(msg_index) over (partition by session_id) as last_index from f),
    s as (select *, session_id || '-task-' || task_n as task_id, msg_index as msg_index_start,
                 coalesce(lead(msg_index) over w - 1, last_index) as msg_index_end, lead(text) over w as next_text
          from g where is_start = 1 window w as (partition by session_id order by msg_index))"""


def outcome_case(column: str, value: bool) -> str:
    """C1 as a CASE over ``column`` (raw text); category or evidence."""
    low = f"trim(lower({column}), {BLANK})"
    gen = "(?i)^(?:" + "|".join(p.replace("^", "") for p in P.GENERATED_TEXT) + ")"
    pick = (lambda c, e: quoted(c)) if value else (lambda c, e: quoted(e))
    rows = [f"when {column} is null then {pick('session_end', 'session terminated')}",
            f"when regexp_matches(trim({column}, {BLANK}), {quoted(gen)}) then {pick('system_continuation', 'auto-generated')}"]
    rows += [f"when {hit(low, p)} then {pick('satisfaction', e)}" for p, e in P.PLEASED]
    for p, e in P.DISPLEASED:
        inner = p[2:-2] if p.startswith(r"\b") else p
        rx = quoted(f"(?s)^(|.*?{NW})({inner})(?:$|{NW})")
        start = f"length(regexp_extract({low}, {rx}, 1))"
        size = f"length(regexp_extract({low}, {rx}, 2))"
        left = f"greatest({start} - 20, 0)"
        around = f"substring({low}, {left} + 1, {start} + {size} + 20 - {left})"
        rows.append(f"when {hit(low, p)} and not {hit(around, P.QUESTION_ABOUT_FIX)} then {pick('dissatisfaction', e)}")
    rows += [f"when {hit(low, p)} then {pick('continuation', e)}" for p, e in P.CARRYING_ON]
    rows.append(f"when length({low}) > 20 then {pick('new_task', 'new request')}")
    return "case " + "\n".join(rows) + f" else {pick('unclear', '')} end"


OUTCOME_SQL = f"""with {marked_sql()},
    o as (select cohort, {outcome_case('next_text', True)} as outcome_category,
                 {outcome_case('next_text', False)} as outcome_evidence from s)
    select cohort, outcome_category, outcome_evidence, count(*)::bigint as tasks from o group by all"""


@query("task_outcomes", OUTCOME_SQL)
def task_outcomes(spark, folder):
    """W1, W3, C1, A12."""
    found = G.with_outcome(B.conversation_tasks(spark, folder))
    return found.groupBy("cohort", "outcome_category", "outcome_evidence").agg(F.count(F.lit(1)).alias("tasks"))


@query("task_ranges", f"with {marked_sql()} select task_id, cohort, task_n, msg_index_start, msg_index_end from s")
def task_ranges(spark, folder):
    """W2, W5."""
    return B.conversation_tasks(spark, folder).select(
        "task_id", "cohort", "task_n", "msg_index_start", "msg_index_end")


@query("next_user_message", f"with {marked_sql()} select task_id, text as prompt, next_text from s")
def next_user_message(spark, folder):
    """P1, P2, W3, whole texts."""
    return B.conversation_tasks(spark, folder).select("task_id", "prompt", "next_text")


@query("document_outcomes", f"""with o as (select lang, {outcome_case('text', True)} as outcome_category from documents)
    select lang, outcome_category, count(*)::bigint as docs from o group by all""")
def document_outcomes(spark, folder):
    """C1 over every document text."""
    docs = B.documents(spark, folder).withColumn("o", O.task_outcome(F.col("text")))
    return docs.groupBy("lang", F.col("o.category").alias("outcome_category")).agg(F.count(F.lit(1)).alias("docs"))


CLEAN_SQL = f"""with {marked_sql()},
    c as (select s.*, (select count(*) from m where m.session_id = s.session_id and m.role = 'assistant'
                        and m.msg_index between s.msg_index_start and s.msg_index_end) as tools,
                 {outcome_case('next_text', True)} as outcome, trim(text, {BLANK}) as p from s),
    x as (select *, case
        when regexp_matches(p, '^<command-(?:name|message)>|^/[\\p{{L}}\\p{{N}}_]+') then 'slash_command'
        when outcome = 'system_continuation'
          or regexp_matches(p, {quoted('(?i)^(?:' + '|'.join(g.replace('^', '') for g in P.GENERATED_TEXT) + ')')})
          then 'system_continuation'
        when rtrim(lower(p), '.') in ({', '.join(quoted(a) for a in P.BARE_ACKS)}) and tools = 0
          and msg_index_end - msg_index_start < 5 then 'empty_continuation'
        when tools = 0 and msg_index_end = msg_index_start and outcome = 'session_end' then 'no_response_interrupt'
        else '' end as reason from c),
    k as (select cohort, 'total' as kind, 'all' as name from x
      union all select cohort, 'status', case when reason = '' then 'included' else 'excluded' end from x
      union all select cohort, 'reason', reason from x where reason <> ''
      union all select cohort, 'flag', 'no_project' from x where reason = '' and conv_id % 7 = 0
      union all select cohort, 'flag', 'interrupted' from x where reason = '' and contains(text, '[Request interrupted')
      union all select cohort, 'flag', 'meta' from x where reason = '' and conv_id % 5 = 0)
    select cohort, kind, name, count(*)::bigint as count from k group by all"""


@query("cleaning_report", CLEAN_SQL)
def cleaning_report(spark, folder):
    """Assistant turns stand for tools, turns for seconds."""
    marked = G.mark_tasks(B.conversation_messages(spark, folder))
    work = marked.where("task_n > 0").groupBy("session_id", "task_n").agg(
        F.count_if(F.col("type") == "assistant").alias("tool_count"))
    starts = G.with_outcome(G.task_starts(marked)).join(work, ["session_id", "task_n"])
    prompt = F.col("prompt")
    project = F.when(F.col("session_id").cast("long") % 7 != 0, F.lit("some-project")).otherwise("")
    checked = starts.withColumn("exclude_reason", TK.exclude_reason(
        prompt, F.col("outcome_category"), F.col("tool_count"), F.col("msg_index_end") - F.col("msg_index_start")))
    flagged = checked.withColumn("flags", TK.task_flags(
        prompt, F.col("session_id").cast("long") % 5 == 0, project, F.lit(0), F.col("exclude_reason")))
    return D.cleaning_stats(flagged, ["cohort"])


@query("basic_segments", f"""with {marked_sql(BASIC)},
    o as (select task_id, task_n, case when next_text is null then 'session_end'
            when {any_hit('lower(next_text)', P.DONE_SIGNALS)} then 'explicit_done'
            when {any_hit('lower(next_text)', P.UNHAPPY_SIGNALS)} then 'user_dissatisfied'
            else 'user_continues' end as completion_signal from s)
    select task_id, task_n, completion_signal, completion_signal <> 'user_dissatisfied' as appears_successful from o""")
def basic_segments(spark, folder):
    """W27, C2, P25."""
    marked = G.mark_tasks(B.conversation_messages(spark, folder), P.BASIC_SKIP_TAGS)
    return G.basic_segments(marked).select("task_id", "task_n", "completion_signal", "appears_successful")


PLAN_INPUT = """p as (select session_id, task_n, msg_index_start, length(text) as n,
        case when length(text) % 5 = 0 then 'plan' when length(text) % 5 = 1 then 'interrupt' else 'real' end as kind,
        length(text) % 2 = 0 as used_planning from s)"""


@query("plan_merge", f"""with {marked_sql()}, {PLAN_INPUT},
    i as (select *, sum((kind = 'real')::int) over w as island from p
          window w as (partition by session_id order by task_n)),
    r as (select *, max(case when kind = 'real' and used_planning then task_n end) over (partition by session_id, island) as front,
                 min(case when kind = 'plan' then task_n end) over (partition by session_id, island) as first_plan,
                 max(case when kind = 'plan' then task_n end) over (partition by session_id, island) as last_plan from i)
    select session_id, task_n,
           case when kind = 'plan' or (kind = 'interrupt' and coalesce(task_n < last_plan, false))
                then coalesce(front, first_plan) else task_n end as root_n,
           coalesce(kind = 'plan' and coalesce(front, first_plan) = task_n, false) as promoted from r""")
def plan_merge(spark, folder):
    """Prompts typed by the length of the text."""
    size = F.length("prompt")
    tasks = B.conversation_tasks(spark, folder).select(
        "session_id", "task_n", "msg_index_start",
        F.when(size % 5 == 0, F.concat(F.lit("Implement the following plan: "), "prompt"))
        .when(size % 5 == 1, F.concat(F.lit("[Request interrupted by user] "), "prompt"))
        .otherwise(F.concat(F.lit("x "), "prompt")).alias("user_prompt"),
        (size % 2 == 0).alias("used_planning"), F.lit("").alias("exclude_reason"))
    return TK.plan_roots(tasks)


def quality(df, size):
    """Annotation columns derived from the length of the text."""
    return (
        df.withColumn("alignment_score", (size % 5 + 1).cast("double"))
        .withColumn("normalized_user_sentiment", F.when(size % 3 == 0, "satisfied").when(size % 3 == 1, "neutral")
                    .otherwise("dissatisfied"))
        .withColumn("task_completion", F.when(size % 4 == 0, "partial").otherwise("complete"))
        .withColumn("tools_per_file", (size % 7).cast("double"))
        .withColumn("user_corrections", (size % 2).cast("long")).withColumn("edit_count", (size % 6).cast("long")))


QUALITY_SQL = """count(*)::bigint as tasks, count(n)::bigint as scored_tasks, avg(n % 5 + 1) as avg_alignment_score,
        100.0 * count_if(n % 3 = 0) / count(*) as satisfaction_rate, 100.0 * count_if(n % 4 <> 0) / count(*) as completion_rate,
        coalesce(avg(case when n % 7 > 0 then n % 7 end), 0) as avg_tools_per_file"""
QUALITY_OUT = """tasks, scored_tasks, round(avg_alignment_score::double, 6) as avg_alignment_score,
        round(satisfaction_rate::double, 6) as satisfaction_rate, round(completion_rate::double, 6) as completion_rate,
        round(avg_tools_per_file::double, 6) as avg_tools_per_file"""
RANKED_SQL = """k as (select cohort, session_id, length(text) as n, row_number() over (partition by session_id order by msg_index_start) as nth,
               count(*) over (partition by session_id) as session_n from s)"""


@query("warmup_split", f"""with {marked_sql()}, {RANKED_SQL},
    q as (select cohort, case when nth <= 1 then 'early' else 'later' end as phase, {QUALITY_SQL}
          from k where session_n >= 2 group by all)
    select cohort, phase, {QUALITY_OUT} from q""")
def warmup_split(spark, folder):
    """Conversations are short, so one early task and sessions of two."""
    tasks = quality(B.conversation_tasks(spark, folder), F.length("prompt"))
    ranked = TM.task_rank_in_session(tasks, ["session_id"], ["msg_index_start"], S.index_chunk("msg_index_start"))
    return tidy(TM.warmup(ranked, ["cohort"], min_tasks=2, early=1))


@query("session_length", f"""with {marked_sql()}, {RANKED_SQL},
    q as (select cohort, case when session_n <= 1 then 'one' when session_n <= 2 then 'two' else 'more' end as bucket,
                 count_if(nth = 1)::bigint as sessions, {QUALITY_SQL} from k group by all)
    select cohort, bucket, sessions, {QUALITY_OUT} from q""")
def session_length(spark, folder):
    """A28."""
    tasks = quality(B.conversation_tasks(spark, folder), F.length("prompt"))
    ranked = TM.task_rank_in_session(tasks, ["session_id"], ["msg_index_start"], S.index_chunk("msg_index_start"))
    return tidy(TM.session_length(ranked, ["cohort"], [("one", 1), ("two", 2), ("more", None)]))


# --- event log ------------------------------------------------------------------
EV = """e as (select user_id as session_id, strftime(ts, '%Y-%m-%d') as day, event_type as name, event_id, ts,
        epoch_us(ts) / 1000000.0::double as at_s, value, (props->>'$.k')::bigint as k,
        case when user_id % 2 = 0 then 'a' else 'b' end as cohort from events)"""
TASK = ["session_id", "day"]
ORDER = ["at_s", "event_id"]


def hour():
    return S.time_chunk(F.col("at_s"))


@query("tool_sequence", f"""with {EV}, l as (select *, lag(name) over w as prev from e
        window w as (partition by session_id, day order by ts, event_id)),
    c as (select *, row_number() over (partition by session_id, day order by ts, event_id) as nth from l
          where prev is null or prev <> name)
    select session_id, day, string_agg(name, '→' order by nth) as tool_sequence from c where nth <= 10 group by all""")
def tool_sequence(spark, folder):
    """W6."""
    return TK.tool_sequence(B.event_calls(spark, folder), TASK, ("at_s", "event_id"), hour())


@query("tool_ngrams", f"""with {EV}, l as (select *, lead(name, 1) over w as n2, lead(name, 2) over w as n3 from e
        window w as (partition by session_id, day order by ts, event_id)),
    g as (select cohort, 2 as size, name || '->' || n2 as gram from l where n2 is not null
          union all select cohort, 3, name || '->' || n2 || '->' || n3 from l where n3 is not null)
    select cohort, size::bigint as size, gram, count(*)::bigint as count from g group by all""")
def tool_ngrams(spark, folder):
    """W20."""
    return tidy(TM.tool_ngrams(B.event_calls(spark, folder), TASK, ORDER, hour(), ["cohort"]))


@query("top_ngrams", f"""with {EV}, l as (select *, lead(name, 1) over w as n2, lead(name, 2) over w as n3 from e
        window w as (partition by session_id, day order by ts, event_id)),
    g as (select cohort, 2 as size, name || '->' || n2 as gram from l where n2 is not null
          union all select cohort, 3, name || '->' || n2 || '->' || n3 from l where n3 is not null),
    c as (select cohort, size::bigint as size, gram, count(*)::bigint as count from g group by all),
    r as (select *, row_number() over (partition by cohort, size order by count desc, gram) as rank from c)
    select cohort, size, gram, count, rank from r where rank <= 10""")
def top_ngrams(spark, folder):
    """O2: top ten of a report, ties by name."""
    grams = TM.tool_ngrams(B.event_calls(spark, folder), TASK, ORDER, hour(), ["cohort"])
    return tidy(TM.top_per_group(grams, ["cohort", "size"], [F.desc("count"), F.asc("gram")], 10))


@query("request_usage", f"""with {EV}, r as (select cohort, session_id, day, extract(hour from ts) as h,
        arg_min(value, ts) as first_value, max(value) as top, min(ts) as t0, max(ts) as t1 from e group by all)
    select cohort, session_id, day, count(*)::bigint as requests, round(sum(first_value), 6) as input,
           round(sum(top), 6) as output, round(sum(epoch_us(t1) - epoch_us(t0)) / 1000000.0::double, 6) as seconds
    from r group by all""")
def request_usage(spark, folder):
    """A user-hour is a request, the value a counter."""
    e = B.event_calls(spark, folder)
    reqs = e.groupBy("cohort", *TASK, F.floor(F.col("at_s") / 3600).alias("request")).agg(
        F.min_by("value", "at_s").alias("input"), F.max("value").alias("output"),
        (F.max("at_s") - F.min("at_s")).alias("seconds"))
    return tidy(reqs.groupBy("cohort", *TASK).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"),
        F.sum("seconds").alias("seconds")))


@query("cold_warm_cache", f"""with {EV}, n as (select *, row_number() over w as nth, count(*) over (partition by session_id, day) as n from e
        window w as (partition by session_id, day order by ts, event_id))
    select cohort, count_if(nth = 1)::bigint as tasks_analyzed,
           round(avg(case when nth = 1 then value end), 6) as avg_first_write, round(avg(case when nth > 1 then value end), 6) as avg_later_write,
           round(avg(case when nth = 1 then k end), 6) as avg_first_read, round(avg(case when nth > 1 then k end), 6) as avg_later_read,
           round(avg(case when nth = 1 then value end) / avg(case when nth > 1 then value end), 6) as cold_write_ratio
    from n where n >= 2 group by all""")
def cold_warm_cache(spark, folder):
    """Every event is a request of its user-day."""
    e = B.event_calls(spark, folder).withColumn("cache_write", F.col("value")).withColumn("cache_read", F.col("k"))
    return tidy(TM.cold_warm(e, TASK, ORDER, ["cohort"]))


STATS_OUT = """count(v)::bigint as count, round(avg(v), 6) as mean, round(median(v), 6) as median,
       round(stddev_samp(v), 6) as stdev, round(quantile_cont(v, 0.1), 6) as p10, round(quantile_cont(v, 0.25), 6) as p25,
       round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75, round(quantile_cont(v, 0.9), 6) as p90"""

EXPLORE = f"""{EV}, t as (select cohort, session_id, day, min(at_s) as start_s, max(at_s) - min(at_s) as dur,
        min(case when name in ('purchase', 'signup') then at_s end) as w, bool_or(name = 'view') as r from e group by all)"""


@query("explore_phase", f"""with {EXPLORE}, x as (select cohort, w - start_s as v from t where dur > 0 and w is not null)
    select cohort, {STATS_OUT} from x group by all""")
def explore_phase(spark, folder):
    """Purchases and sign-ups write, views read."""
    return tidy(R.summary_stats(_explore(spark, folder), ["cohort"], "explore_seconds"))


@query("explore_counts", f"""with {EXPLORE} select cohort, count_if(w is not null)::bigint as tasks_with_edits,
        count_if(w is null and r)::bigint as explore_only_tasks,
        round(avg(case when w is not null then (w - start_s) / dur end), 6) as avg_explore_ratio
        from t where dur > 0 group by all""")
def explore_counts(spark, folder):
    """W21."""
    return tidy(_explore(spark, folder).groupBy("cohort").agg(
        F.count_if("has_write").alias("tasks_with_edits"), F.count_if("explore_only").alias("explore_only_tasks"),
        F.avg("explore_ratio").alias("avg_explore_ratio")))


def _explore(spark, folder):
    e = B.event_calls(spark, folder)
    tasks = e.groupBy("cohort", *TASK).agg(
        F.min("at_s").alias("start_s"), (F.max("at_s") - F.min("at_s")).alias("duration_seconds"))
    return TM.explore_phase(e.drop("cohort"), tasks, TASK, ["purchase", "signup"], "view")


BLOCK = f"""{EV}, b as (select cohort, session_id::varchar || '/' || day as session_id, floor(at_s / 14400)::bigint as block,
        min(at_s) as start_s, max(at_s) as end_s, sum(value) as cost from e group by all),
    g as (select *, end_s - start_s as dur, start_s - lag(end_s) over (partition by session_id order by start_s, block) as gap from b)"""


def _gaps(spark, folder):
    return TM.task_gaps(B.block_tasks(spark, folder), ["cohort", "session_id"], "block")


@query("gap_stats", f"""with {BLOCK}, x as (select cohort, gap as v, 'all' as band from g where gap > 0
        union all select cohort, gap, case when gap <= 9000 then 'short' else 'long' end from g where gap > 0)
    select cohort, band, {STATS_OUT} from x group by all""")
def gap_stats(spark, folder):
    """W13, A8, A10, A32."""
    return tidy(TM.gap_stats(_gaps(spark, folder), ["cohort"], 9000.0))


@query("active_time_cost", f"""with {BLOCK}, th as (select unnest([60, 120, 240, 480]) as m),
    s as (select cohort, session_id, m, sum(cost) as cost, sum(case when dur > 0 then dur else 0 end)
                 + sum(case when gap > 0 and gap <= m * 60 then gap else 0 end) as a from g, th group by all)
    select cohort, m::bigint as threshold_min, round(sum(a) / 3600, 6) as total_active_hours, round(sum(cost), 6) as total_cost,
           round(sum(cost) / (sum(a) / 3600), 6) as cost_per_active_hour, count_if(a > 0)::bigint as session_count,
           round(avg(case when a > 0 then cost / (a / 3600) end), 4) as mean_session_rate
    from s group by all""")
def active_time_cost(spark, folder):
    """A31."""
    out = TM.active_time_cost(_gaps(spark, folder), ["cohort"], ["session_id"], [60, 120, 240, 480])
    return tidy(out).withColumn("mean_session_rate", F.round("mean_session_rate", 4))


RANGES = f"""{EV}, d as (select cohort, session_id::varchar || '/' || day as session_id, min(at_s) as start_s, max(at_s) as end_s
        from e group by cohort, session_id, day), iv as (select * from d where end_s > start_s)"""


@query("concurrency", f"""with {RANGES}, st as (select cohort, start_s as moment, 1 as d from iv union all select cohort, end_s, -1 from iv),
    c as (select cohort, sum(d) over (partition by cohort order by moment, d rows unbounded preceding) as active from st),
    p as (select a.cohort, count(*) as n from iv a join iv b on a.cohort = b.cohort and a.session_id <> b.session_id
          and (a.start_s < b.start_s or (a.start_s = b.start_s and a.session_id < b.session_id)) and b.start_s < a.end_s group by all),
    s as (select cohort, count(*) as n from iv group by all)
    select c.cohort, s.n::bigint as session_count, p.n::bigint as overlapping_pairs, max(c.active)::bigint as max_concurrency
    from c join p on c.cohort = p.cohort join s on s.cohort = c.cohort group by all""")
def concurrency(spark, folder):
    """W15, J7."""
    return I.concurrency(B.day_ranges(spark, folder), ["cohort"]).select(
        "cohort", F.col("session_count").cast("long").alias("session_count"), "overlapping_pairs",
        F.col("max_concurrency").cast("long").alias("max_concurrency"))


@query("activity_periods", f"""with {RANGES}, o as (select *, max(end_s) over (partition by cohort order by start_s, end_s
        rows between unbounded preceding and 1 preceding) as before from iv),
    i as (select *, sum((before is null or start_s > before)::int) over (partition by cohort order by start_s, end_s rows unbounded preceding) as island from o)
    select cohort, round(min(start_s), 6) as period_start, round(max(end_s), 6) as period_end from i group by cohort, island""")
def activity_periods(spark, folder):
    """W14."""
    return tidy(I.activity_periods(B.day_ranges(spark, folder), ["cohort"]))


@query("gap_class", f"""with {BLOCK}, r as (
        select session_id::varchar || '/' || day as session_id, min(at_s) as s, max(at_s) as t from e group by session_id, day),
    iv as (select * from r where t > s),
    q as (select session_id, gap, start_s - gap / 2 as mid from g where gap > 0),
    k as (select q.*, exists (select 1 from iv where iv.session_id <> q.session_id and iv.s <= q.mid and q.mid <= iv.t) as other from q)
    select case when other then 'context_switch' else 'true_idle' end as gap_class, count(*)::bigint as gaps,
           round(sum(gap), 4) as total_seconds, round(avg(gap), 4) as mean_seconds from k group by all""")
def gap_class(spark, folder):
    """J8."""
    gaps = _gaps(spark, folder).where("gap_seconds > 0").select(
        "session_id", F.col("prev_end_s").alias("gap_start_s"), F.col("start_s").alias("gap_end_s"))
    found = I.classify_gaps(gaps, B.day_ranges(spark, folder))
    return tidy(found.groupBy("gap_class").agg(
        F.count(F.lit(1)).alias("gaps"), F.sum("gap_seconds").alias("total_seconds"),
        F.avg("gap_seconds").alias("mean_seconds")), 4)


FRONT = f"""{EV}, n as (select *, row_number() over w as nth, count(*) over (partition by session_id, day) as n from e
        window w as (partition by session_id, day order by ts, event_id)),
    t as (select cohort, session_id, day, max(n) as n, count_if(name in ('view', 'click')) as r, count_if(name = 'purchase') as i,
          count_if(name in ('view', 'click') and nth <= n // 2) as r1, count_if(nth <= n // 2) as n1 from n group by all),
    f as (select *, case when n >= 4 then r1 / n1 - (r - r1) / (n - n1) end as score from t)"""


@query("frontload", f"""with {FRONT} select session_id, day, n::bigint as total_tools, r::bigint as research_count,
        i::bigint as impl_count, round(r / n, 6) as research_ratio, round(i / n, 6) as impl_ratio, round(score, 6) as frontload_score from f""")
def frontload(spark, folder):
    """W17, C16."""
    return tidy(_front(spark, folder).drop("cohort"))


def _front(spark, folder):
    return TM.frontload(B.event_calls(spark, folder), ["cohort", *TASK], ORDER, hour(), ["view", "click"], ["purchase"])


@query("effort_summary", f"""with {FRONT} select cohort, count(*)::bigint as tasks_analyzed, round(avg(r / n), 6) as avg_research_ratio,
        round(avg(i / n), 6) as avg_impl_ratio, count(score)::bigint as tasks_with_frontload_data,
        round(avg(score), 6) as avg_frontload_score, round(100.0 * count_if(score > 0) / count(score), 6) as frontload_positive_pct
        from f group by all""")
def effort_summary(spark, folder):
    """A29."""
    return tidy(TM.effort_summary(_front(spark, folder), ["cohort"]))


DID = f"""{BLOCK}, ev as (select session_id::varchar || '/' || day as session_id, min(at_s) as event_s from e
          where name = 'error' and k % 3 = 0 group by session_id, day),
    mx as (select cohort, session_id::varchar || '/' || day as session_id, min(at_s) as s0, max(at_s) as s1 from e group by cohort, session_id, day),
    md as (select mx.cohort, quantile_cont((ev.event_s - s0) * 100 / (s1 - s0), 0.5) as pct from ev join mx using (session_id)
           where s1 > s0 group by mx.cohort),
    k as (select b.*, floor(b.cost * 10)::bigint as z, row_number() over (partition by b.session_id order by b.start_s, b.block) as nth,
          count(*) over (partition by b.session_id) as n from b),
    a as (select k.*, ev.event_s, case when ev.event_s is not null then 'treated' else 'control' end as arm,
          case when (ev.event_s is not null and k.start_s < ev.event_s) or (ev.event_s is null
            and nth - 1 < greatest(1, least(floor(n * coalesce(md.pct, 50) / 100), n - 1))) then 'pre' else 'post' end as phase
          from k left join ev using (session_id) left join md on md.cohort = k.cohort),
    o as (select cohort, arm, phase, avg(z % 5 + 1) as avg_alignment, count_if(z % 3 = 0) / count(*) as satisfaction_rate,
          count_if(z % 3 = 2) / count(*) as dissatisfaction_rate, count_if(z % 4 <> 0) / count(*) as completion_rate,
          sum(z % 2) / nullif(sum(z % 6), 0) as user_correction_rate from a group by all),
    l as (unpivot o on avg_alignment, satisfaction_rate, dissatisfaction_rate, completion_rate, user_correction_rate
          into name measure value v),
    w as (select cohort, measure, max(case when arm = 'treated' and phase = 'pre' then v end) as pre,
          max(case when arm = 'treated' and phase = 'post' then v end) as post,
          max(case when arm = 'control' and phase = 'pre' then v end) as control_pre,
          max(case when arm = 'control' and phase = 'post' then v end) as control_post from l group by all)"""


@query("event_split_did", f"""with {DID} select cohort, measure, round(pre, 6) as pre, round(post, 6) as post,
        round(control_pre, 6) as control_pre, round(control_post, 6) as control_post, round(post - pre, 6) as delta,
        round(control_post - control_pre, 6) as control_delta,
        round((post - pre) - (control_post - control_pre), 6) as effect from w""")
def event_split_did(spark, folder):
    """An error is the boundary event of a user-day."""
    tasks = B.block_tasks(spark, folder)
    tasks = quality(tasks, F.floor(F.col("estimated_cost") * 10))
    e = B.event_calls(spark, folder).withColumn(
        "session_id", F.concat_ws("/", F.col("session_id").cast("string"), "day"))
    per_day = e.groupBy("cohort", "session_id").agg(
        F.min("at_s").alias("s0"), F.max("at_s").alias("s1"),
        F.min(F.when((F.col("name") == "error") & (F.col("k") % 3 == 0), F.col("at_s"))).alias("event_s"))
    first = per_day.where("event_s is not null").select("session_id", "event_s")
    place = per_day.where("event_s is not null and s1 > s0").withColumn(
        "pct", (F.col("event_s") - F.col("s0")) * 100 / (F.col("s1") - F.col("s0")))
    median = R.quantiles(place, ["cohort"], "pct", {"median_pct": 0.5})
    split = BH.split_phases(tasks, first, median, ["cohort"], ["start_s", "block"],
                            S.time_chunk(F.col("start_s"), S.HOUR * 24))
    return tidy(BH.difference_in_differences(BH.outcome_metrics(split, ["cohort", "arm", "phase"]), ["cohort"]))


@query("session_metadata", f"""with {EV}, c as (select session_id, name, count(*) as n from e group by all),
    t as (select session_id, arg_max(name, n * 1000 - ascii(name)) as top_tool, string_agg(name || '=' || n, ',' order by name) as tools_used from c group by all),
    b as (select session_id, any_value(cohort) as cohort, count(*)::bigint as events, count_if(name = 'view')::bigint as views, count_if(name = 'click')::bigint as clicks,
          round((max(at_s) - min(at_s)) / 60, 6) as duration_minutes from e group by all)
    select b.*, top_tool, tools_used from b join t using (session_id)""")
def session_metadata(spark, folder):
    """A1: counts by type, most frequent tool (ties by name) and tool counts of a session."""
    e = B.event_calls(spark, folder)
    base = e.groupBy("session_id").agg(
        F.first("cohort").alias("cohort"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("name") == "view").alias("views"), F.count_if(F.col("name") == "click").alias("clicks"),
        ((F.max("at_s") - F.min("at_s")) / 60).alias("duration_minutes"))
    tools = e.groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(
        F.max_by("name", F.col("n") * 1000 - F.ascii("name")).alias("top_tool"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))),
                                 lambda s: F.concat(s["name"], F.lit("="), s["n"].cast("string"))), ",").alias("tools_used"))
    return tidy(base.join(tools, "session_id"))


@query("tool_totals", f"""with {EV}, c as (select cohort, name as tool, count(*)::bigint as calls from e group by all),
    r as (select *, row_number() over (partition by cohort order by calls desc, tool) as rank from c) select * from r where rank <= 15""")
def tool_totals(spark, folder):
    """The fifteen most used tools of a report."""
    counts = B.event_calls(spark, folder).groupBy("cohort", F.col("name").alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"))
    return tidy(TM.top_per_group(counts, ["cohort"], [F.desc("calls"), F.asc("tool")], 15))


@query("tool_result_match", f"""with {EV}, u as (select session_id, event_id, at_s, k from e where name = 'view'),
    r as (select session_id, event_id as result_id, at_s as r_at, k, value from e where name = 'click'),
    j as (select u.session_id, u.event_id, arg_min(r.result_id, r.r_at) as result_id, arg_min(r.value >= 10, r.r_at) as succeeded
          from u join r on u.session_id = r.session_id and u.k = r.k and r.r_at > u.at_s group by all) select * from j""")
def tool_result_match(spark, folder):
    """A click with the same key is the result of an earlier view.

    Keys repeat here, so the first later result comes from an as-of scan, not from joining all pairs.
    """
    e = B.event_calls(spark, folder).where("name in ('view', 'click')")
    result = F.when(F.col("name") == "click", F.struct(F.col("event_id"), (F.col("value") >= 10).alias("ok")))
    seen = S.ordered(e, ["session_id", "k"], ["at_s", "event_id"], S.time_chunk(F.col("at_s"), S.HOUR * 24),
                     r=S.next_after(result))
    return seen.where("name = 'view' and r is not null").select(
        "session_id", "event_id", F.col("r.event_id").alias("result_id"), F.col("r.ok").alias("succeeded"))


@query("error_between", f"""with {EV}, p as (select session_id, event_id, at_s from e where name = 'purchase'),
    a as (select *, lag(at_s) over (partition by session_id order by at_s) as prev_s from p),
    k as (select a.*, (select max(x.at_s) from e x where x.session_id = a.session_id and x.name = 'error' and x.at_s < a.at_s) as last_error from a)
    select session_id, event_id, coalesce(last_error > prev_s, false) as error_between,
           coalesce(at_s - last_error <= 36000, false) as error_near from k""")
def error_between(spark, folder):
    """Error between two purchases of a user, and error within ten hours before one."""
    e = B.event_calls(spark, folder).where("name in ('purchase', 'error')")
    at = F.col("at_s")
    seen = S.ordered(e, ["session_id"], ORDER, S.time_chunk(at, S.HOUR * 24),
                     prev_s=S.latest_before(F.when(F.col("name") == "purchase", at)),
                     last_error=S.latest_before(F.when(F.col("name") == "error", at)))
    return seen.where("name = 'purchase'").select(
        "session_id", "event_id",
        F.coalesce(F.col("last_error") > F.col("prev_s"), F.lit(False)).alias("error_between"),
        F.coalesce(at - F.col("last_error") <= 36000, F.lit(False)).alias("error_near"))


@query("compaction_profile", f"""with {EV}, d as (select cohort, session_id, day, max(at_s) - min(at_s) as dur, count(*) as n from e group by all),
    q as (select cohort, session_id, day, k, name, value, row_number() over (partition by session_id, day order by ts, event_id) - 1 as idx from e),
    v as (select session_id, day, count(*) as events, count_if(k % 2 = 0) as auto_events, sum(case when k > 0 then k end) as ps, count_if(k > 0) as pn,
          sum(case when n > 1 then idx * 100.0 / (n - 1) end) as os, count_if(n > 1) as onn from q join d using (session_id, day)
          where q.name = 'error' group by all),
    j as (select d.*, v.* exclude (session_id, day) from d left join v using (session_id, day))
    select cohort, count(*)::bigint as total_sessions, count(events)::bigint as sessions_with_events,
           round(100.0 * count(events) / count(*), 6) as event_rate_pct, sum(events)::bigint as total_events, sum(auto_events)::bigint as auto_events,
           round(sum(events) / count(events), 6) as events_per_session, round(sum(ps) / sum(pn), 6) as avg_pre_tokens,
           round(sum(os) / sum(onn), 6) as avg_position_pct,
           round(sum(events) / (sum(case when events > 0 then dur end) / 3600), 6) as events_per_hour from j group by cohort""")
def compaction_profile(spark, folder):
    """Errors are the boundary events of a user-day."""
    e = B.event_calls(spark, folder)
    placed = S.ordered(e, TASK, ORDER, hour(), nth=S.position()).withColumn(
        "sid", F.concat_ws("/", F.col("session_id").cast("string"), "day"))
    sess = placed.groupBy("cohort", "sid").agg(
        (F.max("nth") - 1).alias("last_index"), (F.max("at_s") - F.min("at_s")).alias("duration_seconds")
    ).withColumnRenamed("sid", "session_id")
    events = placed.where("name = 'error'").select(
        F.col("sid").alias("session_id"), F.when(F.col("k") % 2 == 0, "auto").otherwise("manual").alias("trigger"),
        F.col("k").alias("pre_tokens"), (F.col("nth") - 1).alias("msg_index"))
    return tidy(BH.compaction_profile(events, sess, ["cohort"]))


@query("task_list", f"""with {EV}, t as (select session_id::varchar || '/' || day as task_id, count(*)::bigint as tool_count,
        round(max(at_s) - min(at_s), 6) as duration_seconds from e group by session_id, day)
    select * from t where tool_count >= 2 order by tool_count desc, task_id limit 20""")
def task_list(spark, folder):
    """The twenty largest tasks of a listing."""
    t = B.event_calls(spark, folder).groupBy("session_id", "day").agg(
        F.count(F.lit(1)).alias("tool_count"), (F.max("at_s") - F.min("at_s")).alias("duration_seconds")
    ).select(F.concat_ws("/", F.col("session_id").cast("string"), "day").alias("task_id"), "tool_count", "duration_seconds")
    return tidy(browse.listed(browse.filter_tasks(t, min_tools=2), "tools", 20))
