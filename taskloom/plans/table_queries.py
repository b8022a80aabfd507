"""Queries over the relational and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.config import CrossCut, Measurements
from taskloom.functions import classify as C
from taskloom.functions import numbers as N
from taskloom.functions import patterns as P
from taskloom.functions import signals as G
from taskloom.operators import abtests as AB
from taskloom.operators import annotate as AN
from taskloom.operators import behavior as BH
from taskloom.operators import bootstrap as BS
from taskloom.operators import browse
from taskloom.operators import dataset as D
from taskloom.operators import edits as E
from taskloom.operators import findings as FI
from taskloom.operators import publish as PB
from taskloom.operators import ranks as R
from taskloom.operators import timing as TM
from taskloom.operators import tokens as TOK
from taskloom.plans.bindings import cohort, document_edits, documents, lines
from taskloom.sources.stage import stage as write_stage
from taskloom.plans.registry import BLANK, any_hit, count_hits, hit, query, quoted, table, tidy


def parity(c: str) -> str:
    return f"case when {c} % 2 = 0 then 'a' else 'b' end"


# --- tokens ---------------------------------------------------------------------
def line_tasks(spark, folder):
    return lines(spark, folder).select(
        cohort("l_orderkey"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("task_id"),
        F.col("l_returnflag").alias("complexity"), F.col("l_linestatus").alias("type"),
        F.col("l_quantity").cast("long").alias("total_input_tokens"),
        F.floor("l_extendedprice").alias("total_output_tokens"),
        F.col("l_partkey").alias("cache_read_tokens"), F.col("l_suppkey").alias("cache_write_tokens"),
        (F.col("l_orderkey") % 4 * 10).alias("thinking_chars"), (F.col("l_orderkey") % 3).alias("thinking_blocks"),
        (F.col("l_linenumber") * 100).cast("long").alias("text_chars"), F.col("l_linenumber").cast("long").alias("request_count"),
        (F.col("l_extendedprice") / 1000).alias("estimated_cost"))


LEVELS = {"complexity": "complexity", "type": "type"}
LINES = f"""t as (select {parity('l_orderkey')} as cohort, l_returnflag as complexity, l_linestatus as type,
        l_quantity::bigint as inp, floor(l_extendedprice)::bigint as outp, l_partkey as cr, l_suppkey as cw,
        l_orderkey % 4 * 10 as th, l_orderkey % 3 as tb, l_linenumber * 100 as tx, l_linenumber as rq, l_extendedprice / 1000 as cost from lineitem),
    x as (select *, 'overall' as grouping, 'all' as group_value from t union all select *, 'complexity', complexity from t
          union all select *, 'type', type from t)"""


@query("token_groups", f"""with {LINES}, g as (select cohort, "grouping", group_value, count(*)::bigint as count,
        sum(inp)::bigint as total_input_tokens, sum(outp)::bigint as total_output_tokens, sum(cost) as total_cost_usd,
        avg(inp) as avg_input_tokens, avg(outp) as avg_output_tokens, avg(cost) as avg_cost_usd, avg(th) as avg_thinking_chars,
        avg(tx) as avg_text_chars, count_if(tb > 0) / count(*) as thinking_ratio, count_if(tb > 0)::bigint as tasks_with_thinking,
        count_if(th = 0) / count(*) as thinking_skip_rate, sum(th) / count_if(tb > 0) as avg_thinking_chars_when_used,
        sum(th // 3)::bigint as estimated_thinking_tokens, sum(tx // 4)::bigint as estimated_text_tokens,
        avg(rq) as avg_requests_per_task, sum(cr)::bigint as cache_read_tokens, sum(cw)::bigint as cache_write_tokens,
        sum(inp) / 1e6 * 15.0::double as ci, sum(outp) / 1e6 * 75.0::double as co, sum(cr) / 1e6 * 1.875::double as crc, sum(cw) / 1e6 * 18.75::double as cwc,
        sum(outp) / sum(rq) as avg_output_per_request, sum(tx) / sum(rq) as avg_text_chars_per_request from x group by all)
    select * exclude (ci, co, crc, cwc, total_cost_usd, avg_input_tokens, avg_output_tokens, avg_cost_usd, avg_thinking_chars, avg_text_chars,
           thinking_ratio, thinking_skip_rate, avg_thinking_chars_when_used, avg_requests_per_task, avg_output_per_request, avg_text_chars_per_request),
           {', '.join(f"round({c}::double, 4) as {c}" for c in ['total_cost_usd', 'avg_input_tokens', 'avg_output_tokens', 'avg_cost_usd', 'avg_thinking_chars', 'avg_text_chars', 'thinking_ratio', 'thinking_skip_rate', 'avg_thinking_chars_when_used', 'avg_requests_per_task', 'avg_output_per_request', 'avg_text_chars_per_request'])},
           round(ci * 100 / (ci + co + crc + cwc), 4) as input_pct, round(co * 100 / (ci + co + crc + cwc), 4) as output_pct,
           round(crc * 100 / (ci + co + crc + cwc), 4) as cache_read_pct, round(cwc * 100 / (ci + co + crc + cwc), 4) as cache_write_pct from g""")
def token_groups(spark, folder):
    """A6, A7, J5."""
    expanded = TOK.expand_groups(line_tasks(spark, folder), LEVELS, ["cohort"])
    return tidy(TOK.token_stats(expanded, ["cohort", "grouping", "group_value"]), 4)


@query("token_medians", f"""with {LINES} select cohort, "grouping", group_value, round(median(cost), 6) as median_cost from x group by all""")
def token_medians(spark, folder):
    """A6 medians over the grouping sets."""
    expanded = TOK.expand_groups(line_tasks(spark, folder), LEVELS, ["cohort"])
    return tidy(R.quantiles(expanded, ["cohort", "grouping", "group_value"], "estimated_cost", {"median_cost": 0.5}))


# --- numbers --------------------------------------------------------------------
SHIP = f"""s as (select {parity('l_orderkey')} as cohort, l_returnflag, datediff('day', o_orderdate, l_shipdate)::double as days
        from lineitem join orders on l_orderkey = o_orderkey)"""


def shipped(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(o, "l_orderkey").select(
        cohort("l_orderkey"), "l_returnflag", F.datediff("l_shipdate", "o_orderdate").cast("double").alias("days"))


@query("duration_buckets", f"""with {SHIP}, b(o, name, lo, hi) as (values (0, 'under_30s', 0, 30), (1, '30s_to_2m', 30, 120), (2, '2m_to_10m', 120, 600),
        (3, '10m_to_1h', 600, 3600), (4, 'over_1h', 3600, 1e18)),
    n as (select cohort, count(*) as n, avg(days) as mean_seconds from s where days > 0 group by all)
    select n.cohort, n::bigint as n, round(mean_seconds, 6) as mean_seconds, o::bigint as bucket_order, name as bucket,
           (select count(*) from s where s.cohort = n.cohort and days > 0 and days >= lo and days < hi)::bigint as count,
           round(100.0 * (select count(*) from s where s.cohort = n.cohort and days > 0 and days >= lo and days < hi) / n, 6) as pct from n, b""")
def duration_buckets(spark, folder):
    """Days between order and shipping in the place of seconds."""
    return tidy(TM.duration_buckets(shipped(spark, folder), ["cohort"], "days"))


@query("nearest_rank", """with r as (select o_orderstatus, o_totalprice as v, row_number() over (partition by o_orderstatus order by o_totalprice) - 1 as i,
        count(*) over (partition by o_orderstatus) as n from orders)
    select o_orderstatus, """ + ", ".join(
        f"max(case when i = floor({p} * (n - 1) + 0.5) then v end) as {k}" for k, p in R.PERCENTILES.items())
       + " from r group by all")
def nearest_rank(spark, folder):
    """A9."""
    return R.quantiles(table(spark, folder, "orders"), ["o_orderstatus"], "o_totalprice", nearest=True)


@query("summary_stats", """select l_returnflag, l_linestatus, count(*)::bigint as count, round(avg(l_extendedprice), 4) as mean,
        round(median(l_extendedprice), 4) as median, round(stddev_samp(l_extendedprice), 4) as stdev, """ + ", ".join(
            f"round(quantile_cont(l_extendedprice, {p}), 4) as {k}" for k, p in R.PERCENTILES.items())
       + " from lineitem group by all")
def summary_stats(spark, folder):
    """A8, A10 with the deviation."""
    return tidy(R.summary_stats(lines(spark, folder), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4)


@query("terciles", """with r as (select o_orderpriority, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as i,
        count(*) over (partition by o_orderpriority) as n from orders where o_totalprice > 0)
    select o_orderpriority, max(case when i = n // 3 then v end) as t1, max(case when i = 2 * n // 3 then v end) as t2 from r group by all""")
def terciles(spark, folder):
    """A17 cut points."""
    return R.terciles(table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice")


@query("tercile_bins", """with r as (select o_orderkey, o_orderpriority, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as i,
        count(*) over (partition by o_orderpriority) as n from orders where o_totalprice > 0),
    c as (select o_orderpriority, max(case when i = n // 3 then v end) as t1, max(case when i = 2 * n // 3 then v end) as t2 from r group by all)
    select o_orderpriority, case when o_totalprice <= t1 then 'short' when o_totalprice <= t2 then 'medium' else 'long' end as bin, count(*)::bigint as n
    from orders join c using (o_orderpriority) group by all""")
def tercile_bins(spark, folder):
    """Rows per tercile."""
    orders = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    cuts = R.terciles(orders, ["o_orderpriority"], "o_totalprice")
    return orders.join(cuts, "o_orderpriority").groupBy(
        "o_orderpriority", E.tercile_of(F.col("o_totalprice"), F.col("t1"), F.col("t2")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


# --- distributions ----------------------------------------------------------------
@query("distribution", """select lang, source, count(*)::bigint as count, round(100.0 * count(*) / sum(count(*)) over (partition by lang), 6) as pct
        from documents group by lang, source""")
def distribution(spark, folder):
    """A12."""
    return tidy(D.distribution(documents(spark, folder), ["lang"], "source"))


@query("unknown_rate", """with d as (select lang, (n_chars < 300) as u from documents)
    select lang, count(*)::bigint as total, count_if(u)::bigint as unknown, round(100.0 * count_if(u) / count(*), 6) as unknown_pct from d group by rollup(lang)""")
def unknown_rate(spark, folder):
    """Short documents count as unknown."""
    d = documents(spark, folder).withColumn("type", F.when(F.col("n_chars") < 300, "unknown").otherwise("known"))
    return tidy(D.unknown_rate(d, "lang", "type"))


@query("side_by_side", f"""select l_returnflag, sum(case when l_orderkey % 2 = 0 then 1 end)::bigint as a, sum(case when l_orderkey % 2 = 1 then 1 end)::bigint as b,
        round(100.0 * (sum(case when l_orderkey % 2 = 1 then 1 end) - sum(case when l_orderkey % 2 = 0 then 1 end)) / sum(case when l_orderkey % 2 = 0 then 1 end), 6) as pct_change
        from lineitem group by all""")
def side_by_side(spark, folder):
    """J17, U3, P24."""
    counts = table(spark, folder, "lineitem").groupBy("l_returnflag", cohort("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    wide = D.side_by_side(counts, ["l_returnflag"], "n", ("a", "b"))
    return tidy(wide.withColumn("pct_change", N.deltas(F.col("a"), F.col("b"))["pct_change"]))


@query("dataset_overview", f"""select {parity('o_orderkey')} as cohort, count(*)::bigint as sessions, count(distinct o_custkey)::bigint as projects,
        strftime(min(o_orderdate), '%Y-%m-%d') as first_day, strftime(max(o_orderdate), '%Y-%m-%d') as last_day,
        sum(o_custkey)::bigint as user_messages, sum(o_orderkey)::bigint as assistant_messages, sum(o_orderkey % 10)::bigint as tool_calls,
        round(sum(case when o_totalprice <> 0 and o_totalprice < 1440 then o_totalprice end) / 60, 6) as session_hours
        from orders group by rollup({parity('o_orderkey')})""")
def dataset_overview(spark, folder):
    """A14, A15, P20."""
    s = table(spark, folder, "orders").select(
        cohort("o_orderkey"), F.col("o_custkey").alias("project_path"), F.col("o_orderdate").cast("string").alias("start_time"),
        F.col("o_custkey").alias("user_message_count"), F.col("o_orderkey").alias("assistant_message_count"),
        (F.col("o_orderkey") % 10).alias("tool_call_count"), F.col("o_totalprice").alias("duration_minutes"))
    return tidy(D.session_overview(s))


ORDER_SQL = f"""t as (select o_orderkey::varchar as task_id, o_orderkey, {parity('o_orderkey')} as cohort, o_orderstatus as type, o_orderpriority, o_totalprice,
        case when o_orderkey % 3 = 0 then 'satisfaction' when o_orderkey % 3 = 1 then 'dissatisfaction' else 'unclear' end as outcome,
        coalesce(n, 0) as tools, coalesce(files, 0) as files, coalesce(added, 0) as added, coalesce(removed, 0) as removed from orders left join (
        select l_orderkey, count(*) as n, count(distinct l_suppkey) as files, sum(l_quantity)::bigint as added,
               sum(case when l_returnflag = 'R' then l_quantity else 0 end)::bigint as removed from lineitem group by all) on l_orderkey = o_orderkey)"""


def order_tasks(spark, folder):
    """Tasks: an order with its lines as tools, its suppliers as files and its quantities as lines."""
    lines = table(spark, folder, "lineitem")
    suppliers = lines.select("l_orderkey", "l_suppkey").distinct().groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("total_files_touched"))
    sums = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("tool_count"), F.sum("l_quantity").cast("long").alias("total_lines_added"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("long").alias("total_lines_removed"))
    k = F.col("o_orderkey") % 3
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").cast("string").alias("task_id"), cohort("o_orderkey"),
        F.col("o_orderstatus").alias("type"), "o_orderpriority", F.col("o_totalprice").alias("duration_seconds"),
        F.when(k == 0, "satisfaction").when(k == 1, "dissatisfaction").otherwise("unclear").alias("outcome_category"))
    t = o.join(sums, "l_orderkey", "left").join(suppliers, "l_orderkey", "left")
    return t.na.fill(0, ["tool_count", "total_files_touched", "total_lines_added", "total_lines_removed"])


@query("efficiency", f"""with {ORDER_SQL} select cohort, type, count(*)::bigint as count, count_if(files > 0)::bigint as with_changes,
        round(avg(tools), 6) as avg_tools, round(avg(case when files > 0 then files end), 6) as avg_files,
        round(avg(case when added + removed > 0 then added + removed end), 6) as avg_lines,
        round(avg(case when files > 0 then tools / files end), 6) as tools_per_file,
        round(avg(case when files > 0 and added + removed > 0 then tools / ((added + removed) / 100) end), 6) as tools_per_100_lines,
        round(100.0 * count_if(outcome = 'dissatisfaction') / count(*), 6) as dissat_pct from t group by all""")
def efficiency(spark, folder):
    """A33."""
    return tidy(D.efficiency(order_tasks(spark, folder), ["cohort", "type"]))


@query("complexity", f"""with {ORDER_SQL} select cohort, case when tools <= 3 and files <= 1 and added + removed <= 20 then 'trivial'
        when tools <= 10 and files <= 3 and added + removed <= 100 then 'simple' when tools <= 30 and files <= 10 and added + removed <= 500 then 'moderate'
        when tools <= 80 and files <= 25 and added + removed <= 2000 then 'complex' else 'major' end as complexity, count(*)::bigint as n,
        round(avg(tools), 6) as avg_tools from t group by all""")
def complexity(spark, folder):
    """C4."""
    t = order_tasks(spark, folder)
    level = C.complexity(F.col("tool_count"), F.col("total_files_touched"), F.col("total_lines_added") + F.col("total_lines_removed"))
    return tidy(t.groupBy("cohort", level.alias("complexity")).agg(F.count(F.lit(1)).alias("n"), F.avg("tool_count").alias("avg_tools")))


@query("scope_by_type", f"""with {ORDER_SQL} select cohort, type, count(*)::bigint as count, round(avg(files), 6) as avg_files_touched,
        round(avg(added), 6) as avg_lines_added, round(avg(removed), 6) as avg_lines_removed, round(avg(tools), 6) as avg_tool_calls,
        sum(files)::bigint as total_files_touched, sum(added)::bigint as total_lines_added, sum(removed)::bigint as total_lines_removed from t group by all""")
def scope_by_type(spark, folder):
    """A14."""
    return tidy(D.scope_by(order_tasks(spark, folder), ["cohort", "type"]))


@query("size_route", f"""with {ORDER_SQL} select case when tools = 0 and o_totalprice < 10 then 'trivial'
        when ((tools <= 3 and files <= 1 and added + removed <= 20) or (tools <= 10 and files <= 3 and added + removed <= 100)) and tools <= 3 then 'small'
        else 'normal' end as route, count(*)::bigint as n from t group by all""")
def size_route(spark, folder):
    """P13."""
    t = order_tasks(spark, folder)
    level = C.complexity(F.col("tool_count"), F.col("total_files_touched"), F.col("total_lines_added") + F.col("total_lines_removed"))
    return t.groupBy(AN.route(F.col("tool_count"), F.col("duration_seconds"), level).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("replication_candidates", f"""with {ORDER_SQL}, s as (select task_id, least(tools, 20) / 20 + case when outcome = 'unclear' then 0.5::double else 1.0::double end
        + least(files, 5) / 5 as score from t where tools >= 3 and outcome <> 'unclear' and o_totalprice <= 50000)
    select task_id, round(score, 6) as score from s order by score desc, task_id limit 10""")
def replication_candidates(spark, folder):
    """The ten best candidates of a batch."""
    t = order_tasks(spark, folder).where("duration_seconds <= 50000").withColumn("duration_seconds", F.col("duration_seconds") / 1000)
    return tidy(browse.replication_candidates(t.withColumn("read_calls", F.lit(0))).select("task_id", "score"))


@query("metric_catalogue", f"""with {ORDER_SQL}, g as (select cohort, count(*)::double as count, avg(tools)::double as avg_tools, sum(files)::double as files from t group by all)
    select cohort, 'tasks.' || m as name, round(v, 6) as value from (unpivot g on count, avg_tools, files into name m value v)""")
def metric_catalogue(spark, folder):
    """S16."""
    wide = order_tasks(spark, folder).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("count"), F.avg("tool_count").alias("avg_tools"), F.sum("total_files_touched").alias("files"))
    return tidy(D.metric_catalogue(wide, ["cohort"], "tasks"))


# --- joins ------------------------------------------------------------------------
ENRICH = f"""a as (select o_orderkey as task_id, {parity('o_orderkey')} as cohort, o_totalprice / 1000 as duration_seconds, o_orderpriority as task_completion,
        null as task_type from orders),
    k as (select l_orderkey as task_id, sum(l_quantity)::bigint as inp, sum(l_partkey)::bigint as outp, sum(l_suppkey)::bigint as cr, count(*) as rq,
          sum(l_linenumber)::bigint as th, sum(l_linenumber * 3)::bigint as tx, sum(l_tax) as cost from lineitem where l_linestatus = 'O' group by all),
    d as (select l_orderkey as task_id, count(*) as ec, count_if(l_quantity > 25) as oc from lineitem where l_returnflag = 'R' group by all),
    c as (select l_orderkey as task_id, max(l_returnflag) as type from lineitem where l_returnflag <> 'N' group by all)"""


def enriched(spark, folder):
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    annotated = orders.select(
        F.col("o_orderkey").alias("task_id"), cohort("o_orderkey"), (F.col("o_totalprice") / 1000).alias("duration_seconds"),
        F.col("o_orderpriority").alias("task_completion"))
    tokens = lines.where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.sum("l_quantity").cast("long").alias("total_input_tokens"), F.sum("l_partkey").alias("total_output_tokens"),
        F.sum("l_suppkey").alias("cache_read_tokens"), F.count(F.lit(1)).alias("request_count"),
        F.sum("l_linenumber").alias("thinking_chars"), F.sum(F.col("l_linenumber") * 3).alias("text_chars"),
        F.sum("l_tax").alias("estimated_cost"))
    edits = lines.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.count(F.lit(1)).alias("edit_count"), F.count_if(F.col("l_quantity") > 25).alias("overlap_count"),
        F.lit(0).cast("long").alias("write_count"))
    classified = lines.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.max("l_returnflag").alias("type"))
    return AN.enrich(annotated, tokens, edits, classified,
                     [c for c in tokens.columns if c != "task_id"], [c for c in edits.columns if c != "task_id"])


@query("enrich_join", f"""with {ENRICH}
    select a.task_id, round(case when cost <> 0 and duration_seconds > 0 then cost / (duration_seconds / 60) end, 6) as cost_per_minute,
           round(case when outp <> 0 and rq > 0 then outp / rq end, 6) as output_per_request, round(case when inp is not null and cr + inp > 0 then cr / (cr + inp) end, 6) as cache_hit_rate,
           round(case when th + tx > 0 then th / (th + tx) end, 6) as thinking_fraction, coalesce(ec, 0) > 0 as has_edits, coalesce(oc, 0) > 0 as has_overlaps,
           round(coalesce(oc, 0) / greatest(coalesce(ec, 0), 1), 6) as rewrite_rate, type as task_type, 'partial' as task_completion
    from a left join k using (task_id) left join d using (task_id) left join c using (task_id)""")
def enrich_join(spark, folder):
    """J1, P14, C11."""
    return tidy(enriched(spark, folder).select(
        "task_id", "cost_per_minute", "output_per_request", "cache_hit_rate", "thinking_fraction", "has_edits",
        "has_overlaps", "rewrite_rate", "task_type", "task_completion"))


@query("join_coverage", f"""with {ENRICH} select a.cohort, count(*)::bigint as tasks, count(k.task_id)::bigint as token_hits, count(d.task_id)::bigint as edit_hits,
        count(c.task_id)::bigint as class_hits from a left join k using (task_id) left join d using (task_id) left join c using (task_id) group by all""")
def join_coverage(spark, folder):
    """Hits of each join."""
    return AN.join_coverage(enriched(spark, folder), ["cohort"])


@query("label_coverage", """select lang, count(l.doc_id)::bigint as matched, count(*)::bigint as total, round(100.0 * count(l.doc_id) / count(*), 6) as pct
        from documents d left join labels l using (doc_id) group by all""")
def label_coverage(spark, folder):
    """J4."""
    return tidy(AN.coverage(documents(spark, folder), table(spark, folder, "labels"), ["doc_id"], ["lang"]))


@query("reconcile", """with j as (select d.lang, d.source as type, case when l.doc_id is null then null when quality = 1 then 'feature' else '' end as t,
        case when toxic = 1 then 'low' when d.doc_id % 2 = 0 then 'medium' else 'high' end as c from documents d left join labels l using (doc_id)),
    r as (select lang, case when coalesce(t, '') <> '' and c in ('medium', 'high') then t else type end as final_type,
          case when coalesce(t, '') <> '' and c in ('medium', 'high') then 'annotation' else 'rules' end as type_source from j)
    select lang, final_type, type_source, count(*)::bigint as n from r group by all""")
def reconcile(spark, folder):
    """J3, J13."""
    docs = documents(spark, folder).select(F.col("doc_id").alias("task_id"), "lang", F.col("source").alias("type"))
    notes = table(spark, folder, "labels").select(
        F.col("doc_id").alias("task_id"), F.when(F.col("quality") == 1, "feature").otherwise("").alias("task_type"),
        F.when(F.col("toxic") == 1, "low").when(F.col("doc_id") % 2 == 0, "medium").otherwise("high").alias("task_type_confidence"))
    return AN.reconcile_type(docs, notes).groupBy("lang", "final_type", "type_source").agg(F.count(F.lit(1)).alias("n"))


@query("missing_types", """select l.doc_id as task_id, d.text as prompt from labels l left join documents d using (doc_id) where quality = 0""")
def missing_types(spark, folder):
    """J14."""
    notes = table(spark, folder, "labels").select(
        F.col("doc_id").alias("task_id"), F.when(F.col("quality") == 1, "feature").otherwise("").alias("task_type"))
    docs = documents(spark, folder).select(F.col("doc_id").alias("task_id"), F.col("text").alias("prompt"))
    return AN.missing_types(notes, docs).select("task_id", "prompt")


@query("overlap_projects", f"""with d as (select {parity('n_chars')} as cohort, source || '/' || lang || '/' || n_chars // 500 as p, doc_id from documents),
    s as (select p from d where cohort = 'a' intersect select p from d where cohort = 'b')
    select cohort, count(*)::bigint as docs, count(distinct p)::bigint as projects from d where p in (select p from s) group by all""")
def overlap_projects(spark, folder):
    """J11, U2."""
    d = documents(spark, folder).select(
        cohort("n_chars"), F.concat_ws("/", "source", "lang", F.floor(F.col("n_chars") / 500).cast("string")).alias("project_path"))
    kept = AB.restricted(d, ("a", "b"))
    return kept.groupBy("cohort").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("project_path").alias("projects"))


@query("similar_docs", r"""with w as (select doc_id::varchar as task_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) as words,
        [lang] as tools, n_chars as files from documents),
    t as (select * from w where task_id = (select min(doc_id)::varchar from documents)),
    s as (select w.task_id, 0.5::double * len(list_intersect(w.words, t.words)) / len(list_distinct(list_concat(w.words, t.words)))
          + 0.3::double * (w.tools = t.tools)::int + 0.2::double * (1 - abs(w.files - t.files) / greatest(w.files + t.files, 1)) as score from w, t where w.task_id <> t.task_id)
    select task_id, round(score, 6) as score from s order by score desc, task_id limit 5""")
def similar_docs(spark, folder):
    """The five documents most like the first one."""
    d = documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("user_prompt"), F.array("lang").alias("tools"),
        F.col("n_chars").alias("files"), "doc_id")
    first = d.where(F.col("doc_id") == d.select(F.min("doc_id")).scalar())
    return tidy(browse.similar_to(d.drop("doc_id"), first.drop("doc_id")))


@query("compare_two", """with t as (select o_orderkey::varchar as id, o_totalprice, o_orderstatus, o_custkey, o_orderpriority, o_orderkey from orders),
    x as (select * from t where contains(id, '77') order by id desc limit 1), y as (select * from t where contains(id, '42') order by id desc limit 1)
    select 'Tool calls' as metric, (select o_custkey::varchar from x) as task_1, (select o_custkey::varchar from y) as task_2
    union all select 'Files touched', (select o_orderkey::varchar from x), (select o_orderkey::varchar from y)
    union all select 'Lines added', (select (o_custkey + 1)::varchar from x), (select (o_custkey + 1)::varchar from y)
    union all select 'Lines removed', (select (o_custkey + 2)::varchar from x), (select (o_custkey + 2)::varchar from y)
    union all select 'Duration (s)', (select o_orderpriority from x), (select o_orderpriority from y)
    union all select 'Outcome', (select o_orderstatus from x), (select o_orderstatus from y)""")
def compare_two(spark, folder):
    """J16, P22."""
    t = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_custkey").alias("tool_count"), F.col("o_orderkey").alias("total_files_touched"),
        (F.col("o_custkey") + 1).alias("total_lines_added"), (F.col("o_custkey") + 2).alias("total_lines_removed"),
        F.col("o_orderpriority").alias("duration_seconds"), F.col("o_orderstatus").alias("outcome_category"))
    return browse.compare_two(t, "77", "42")


# --- classification -----------------------------------------------------------------
def types_sql() -> str:
    hits = ", ".join(
        f"case when {any_hit('low', pats, '(?i)')} then {quoted(name)} end" for name, pats in P.TASK_TYPES.items())
    return f"list_filter([{hits}], lambda x: x is not null)"


@query("task_type", f"""with d as (select doc_id, lower(text) as low from documents), h as (select doc_id, {types_sql()} as t from d)
    select doc_id, case when len(t) = 0 then 'unknown' else t[1] end as type, greatest(len(t), 1)::bigint as n_types,
           round(case when len(t) = 0 then 0.15::double else least(1.0::double, len(t) * 0.3::double) end, 6) as confidence from h""")
def task_type(spark, folder):
    """C3, C6."""
    d = documents(spark, folder).select("doc_id", C.task_types(F.col("text")).alias("t"))
    return tidy(d.select("doc_id", F.col("t")[0].alias("type"), F.size("t").alias("n_types"),
                         C.confidence(F.size("t"), F.col("t")[0]).alias("confidence")))


def domain_sql() -> str:
    hits = {n: "(" + " or ".join(f"regexp_matches(url, {quoted('(?i)' + p)})" for p in pats) + ")" for n, pats in P.DOMAINS.items()}
    total = " + ".join(f"{h}::int" for h in hits.values())
    cases = " ".join(f"when {h} then {quoted(n)}" for n, h in hits.items())
    return f"case when {total} = 0 then 'unknown' when {total} > 1 then 'mixed' {cases} end"


@query("domain", f"select page_id, {domain_sql()} as domain from pages")
def domain(spark, folder):
    """One path per page, so two hits are mixed."""
    hits = C.domain_hits(F.col("url"))
    return table(spark, folder, "pages").select(
        "page_id", C.domain_from_counts({d: h.cast("long") for d, h in hits.items()}).alias("domain"))


def vote_sql(votes, default: str) -> str:
    counts = {n: count_hits("low", p) for n, p in votes.items()}
    top = f"greatest({', '.join(counts.values())})"
    return (f"case when {top} = 0 then {quoted(default)} " + " ".join(
        f"when {c} = {top} then {quoted(n)}" for n, c in counts.items()) + " end")


@query("keyword_vote", f"""with d as (select lang, lower(text) as low from documents),
    v as (select lang, {vote_sql(P.QUALITY_VOTES, 'adequate')} as q, {vote_sql(P.WORK_VOTES, 'directed_impl')} as w, {vote_sql(P.SENTIMENT_VOTES, 'neutral')} as s from d)
    select lang, q as normalized_execution_quality, w as normalized_work_category, s as normalized_user_sentiment, count(*)::bigint as n from v group by all""")
def keyword_vote(spark, folder):
    """C9, C10."""
    t = F.col("text")
    d = documents(spark, folder).select("lang", *[c.alias(n) for n, c in G.normalised(t, t, t).items()])
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))


@query("keyword_signals", f"""with d as (select lang, lower(text) as low from documents),
    h as (select lang, {count_hits('low', P.POSITIVE_WORDS)} as p, {count_hits('low', P.NEGATIVE_WORDS)} as n, {count_hits('low', P.CONTINUING_WORDS)} as c from d)
    select lang, case when p + n + c = 0 then 'low' when p + n + c <= 2 then 'medium' else 'high' end as confidence,
           case when p > n then 'satisfied' when n > p then 'dissatisfied' else 'neutral' end as keyword_sentiment,
           count(*)::bigint as docs, sum(p)::bigint as positive_hits, sum(n)::bigint as negative_hits, sum(c)::bigint as continuation_hits from h group by all""")
def keyword_signals(spark, folder):
    """C7, A36 input."""
    s = documents(spark, folder).select("lang", G.keyword_signals(F.col("text"), F.lit("")).alias("k")).select("lang", "k.*")
    return tidy(s.groupBy("lang", F.col("outcome_confidence").alias("confidence"), G.keyword_sentiment(
        F.col("positive_hits"), F.col("negative_hits")).alias("keyword_sentiment")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("positive_hits").alias("positive_hits"),
        F.sum("negative_hits").alias("negative_hits"), F.sum("continuation_hits").alias("continuation_hits")))


@query("normalisation_coverage", f"""with d as (select lang, lower(text) as low from documents)
    select lang, round(sum((({' + '.join(count_hits('low', p) for p in P.QUALITY_VOTES.values())}) > 0)::int
        + (({' + '.join(count_hits('low', p) for p in P.WORK_VOTES.values())}) > 0)::int
        + (({' + '.join(count_hits('low', p) for p in P.SENTIMENT_VOTES.values())}) > 0)::int) / (count(*) * 3), 6) as matched_share, count(*)::bigint as n
    from d group by all""")
def normalisation_coverage(spark, folder):
    """A45."""
    d = documents(spark, folder).select(
        "lang", F.col("text").alias("execution_quality"), F.col("text").alias("work_category"), F.col("text").alias("user_sentiment"))
    return tidy(AN.normalisation_coverage(d, ["lang"]))


RAW = ["complete", " Partial - half done ", "FAILED hard", "not_started", "in_progress", "interrupted", "odd words", ""]


@query("completion_norm", f"""with o as (select o_orderpriority, ({[r for r in RAW]})[1 + o_orderkey % 8] as raw from orders),
    v as (select o_orderpriority, raw, lower(trim(raw, {BLANK})) as v from o)
    select o_orderpriority, raw, case when v in ('complete', 'partial', 'interrupted', 'failed') then v when v like 'failed%' then 'failed'
           when v = 'not_started' then 'interrupted' else 'partial' end as completion, count(*)::bigint as n from v group by all""")
def completion_norm(spark, folder):
    """C11: raw wordings assigned by order key."""
    o = table(spark, folder, "orders").select(
        "o_orderpriority", F.array(*[F.lit(r) for r in RAW])[(F.col("o_orderkey") % 8).cast("int")].alias("raw"))
    return o.groupBy("o_orderpriority", "raw", G.completion(F.col("raw")).alias("completion")).agg(F.count(F.lit(1)).alias("n"))


@query("type_agreement", """with d as (select doc_id, lang, case when quality = 1 then 'en' when toxic = 1 then 'unknown' else 'fr' end as guess
        from documents join labels using (doc_id)) select lang, guess, count(*)::bigint as count from d group by all""")
def type_agreement(spark, folder):
    """Confusion counts."""
    d = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id").select(
        "lang", F.when(F.col("quality") == 1, "en").when(F.col("toxic") == 1, "unknown").otherwise("fr").alias("guess"))
    return AN.type_agreement(d, "lang", "guess", [])[1]


# --- behaviour -----------------------------------------------------------------------
def doc_tasks(spark, folder):
    n = F.col("n_chars")
    return documents(spark, folder).select(
        cohort("doc_id"), F.col("source").alias("session_id"), F.concat(
            F.when(n % 7 == 0, "use agents to ").when(n % 7 == 1, "in parallel ").otherwise(""), "text").alias("user_prompt"),
        (n % 3).alias("subagent_count"), (n % 3 > 0).alias("used_subagents"), (n % 2).alias("run_in_background_count"),
        (n % 2).alias("general_purpose_agents"), (n % 5 == 0).alias("used_planning"), (n % 4).alias("parallel_tool_messages"),
        (n % 4 + 1).alias("messages_with_tools"), "lang", n.alias("n"))


def contains_sql(words) -> str:
    return "(" + " or ".join(f"contains(low, {quoted(w)})" for w in words) + ")"


DOCS = f"""d as (select {parity('doc_id')} as cohort, source, case when n_chars % 7 = 0 then 'use agents to ' when n_chars % 7 = 1 then 'in parallel ' else '' end || lower(text) as low,
        n_chars as n from documents),
    t as (select *, n % 3 as agents, n % 3 > 0 as used, n % 2 as bg, n % 5 = 0 as planned, {contains_sql(P.AGENT_WORDS)} as asked,
          {contains_sql(P.PLANNING_WORDS)} as plan_asked,
          case when {contains_sql(P.PARALLEL_WORDS)} then 'parallel' when {hit('low', P.USE_AGENT_PATTERNS[0])} or {hit('low', P.USE_AGENT_PATTERNS[1])}
               or {any_hit('low', P.USE_AGENT_PATTERNS[2].split('|'))} then 'use_agents' end as directive from d)"""


@query("behavior", f"""with {DOCS} select cohort, count(*)::bigint as total_tasks, count(distinct source)::bigint as total_sessions,
        count_if(used)::bigint as tasks_with_subagents, sum(case when used then agents else 0 end)::bigint as total_subagent_calls,
        sum(case when used then bg else 0 end)::bigint as background_tasks, sum(case when used then agents - bg else 0 end)::bigint as foreground_tasks,
        sum(case when used then bg else 0 end)::bigint as gp_total, sum(case when used and asked then agents else 0 end)::bigint as subagent_user_requested,
        sum(case when used and not asked then agents else 0 end)::bigint as subagent_autonomous, sum(case when used and asked then bg else 0 end)::bigint as gp_user_requested,
        sum(case when used and not asked then bg else 0 end)::bigint as gp_autonomous, count_if(planned)::bigint as tasks_with_planning,
        count_if(planned and plan_asked)::bigint as planning_user_requested, count_if(planned and not plan_asked)::bigint as planning_autonomous,
        sum(n % 4)::bigint as messages_with_parallel, sum(n % 4 + 1)::bigint as messages_with_tools,
        count_if(used and directive = 'parallel')::bigint as parallel_directive_tasks, count_if(used and directive = 'use_agents')::bigint as use_agents_directive_tasks
        from t group by all""")
def behavior(spark, folder):
    """A20, C14, C15."""
    return tidy(BH.behavior(doc_tasks(spark, folder), ["cohort"]))


@query("directive_compliance", f"""with {DOCS} select cohort, directive, count(*)::bigint as tasks, sum(agents)::bigint as agents, sum(bg)::bigint as background
        from t where used and directive is not null group by all""")
def directive_compliance(spark, folder):
    """A23."""
    return tidy(BH.directive_compliance(doc_tasks(spark, folder), ["cohort"]))


CROSS = """j as (select lang, quality = 1 as planned, case when toxic = 0 then n_chars::double end as score from documents join labels using (doc_id)),
    x as (select lang as complexity, planned, score from j union all select null, planned, score from j)"""


@query("planning_crosstab", f"""with {CROSS} select complexity, count(*)::bigint as n, count_if(planned)::bigint as planned, count_if(not planned)::bigint as unplanned,
        round(100.0 * count_if(planned) / count(*), 6) as planning_rate_pct, round(avg(case when planned then score end), 6) as score_planned,
        round(avg(case when not planned then score end), 6) as score_unplanned,
        round(avg(case when planned then score end) - avg(case when not planned then score end), 6) as score_delta,
        count(case when planned then score end)::bigint as n_scored_planned, count(case when not planned then score end)::bigint as n_scored_unplanned,
        round(100.0 * count(score) / count(*), 6) as coverage_pct from x group by all""")
def planning_crosstab(spark, folder):
    """A24."""
    d = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id").select(
        F.col("lang").alias("complexity"), (F.col("quality") == 1).alias("planned"),
        F.when(F.col("toxic") == 0, F.col("n_chars").cast("double")).alias("score"))
    return tidy(BH.planning_crosstab(d, []))


@query("subagent_outcomes", """with j as (select n_chars % 3 = 0 as has_subagent, case when quality = 1 then 'satisfied' when toxic = 1 then 'frustrated' else 'neutral' end as s,
        n_chars % 5 + 1 as score, case when n_chars % 2 = 0 then 'partial - waits' else 'complete' end as c from documents join labels using (doc_id))
    select has_subagent, count_if(s = 'satisfied')::bigint as satisfied, count_if(s = 'frustrated')::bigint as dissatisfied, count_if(s = 'neutral')::bigint as neutral,
           count(*)::bigint as total, round(avg(score), 6) as avg_alignment, count_if(c = 'complete')::bigint as complete, count_if(c <> 'complete')::bigint as partial,
           0::bigint as interrupted, 0::bigint as failed from j group by all""")
def subagent_outcomes(spark, folder):
    """A21."""
    d = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id").select(
        (F.col("n_chars") % 3 == 0).alias("has_subagent"),
        F.when(F.col("quality") == 1, "satisfied").when(F.col("toxic") == 1, "frustrated").otherwise("neutral").alias("normalized_user_sentiment"),
        (F.col("n_chars") % 5 + 1).alias("alignment_score"),
        F.when(F.col("n_chars") % 2 == 0, "partial - waits").otherwise("complete").alias("task_completion"))
    return tidy(BH.subagent_outcomes(d, []))


# --- edits ------------------------------------------------------------------------------
def line_set(text: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, {BLANK})), lambda x: length(x) > 15))"


#: The edits of ``bindings.document_edits``.
EDITS = """e0 as (select source, lang, doc_id, text, coalesce(lag(text ignore nulls) over (partition by source, lang order by doc_id), '') as prev from documents),
    ed0 as (select source as session_id, lang as file_path, source || '-' || (doc_id // 200) as task_id, doc_id, doc_id % 13 = 0 as wr, doc_id % 13 <> 0 and doc_id % 11 = 0 as ra,
        case when doc_id % 13 = 0 then '' when doc_id % 3 = 0 and prev <> '' then prev || chr(10) || text else prev end as old, text as new from e0)"""
LIN = f"""{EDITS}, d as (select *, length(new) >= 20 as adds, not wr and not ra and length(old) >= 20 as probes, wr and length(new) >= 20 as clears,
        {line_set('new')} as ln, {line_set('old')} as lo from ed0),
    pr as (select a.session_id, a.file_path, a.doc_id as a, b.doc_id as b, a.task_id as ta, b.task_id as tb, length(a.new) as la, length(b.old) as lb, a.new = b.old as same,
           contains(b.old, a.new) as fwd, contains(a.new, b.old) as bwd, len(list_intersect(a.ln, b.lo)) as sh, len(a.ln) as na, len(b.lo) as nb
           from d a join d b on a.session_id = b.session_id and a.file_path = b.file_path and a.doc_id < b.doc_id and a.adds and b.probes),
    de0 as (select a, min(b) as death from pr where fwd group by a),
    de as (select d.doc_id as a, least(min(de0.death), min(w.doc_id)) as death from d left join de0 on de0.a = d.doc_id
           left join d w on w.clears and w.session_id = d.session_id and w.file_path = d.file_path and w.doc_id > d.doc_id group by all),
    tr as (select pr.*, case when same then 'exact' when fwd and la >= 40 and la / lb >= 0.3 then 'containment' when bwd and lb >= 40 and lb / la >= 0.3 then 'containment'
           when sh > 0 and (sh / (na + nb - sh) > 0.3 or sh / nb > 0.5) then 'line_overlap' end as tier,
           case when same then 1.0::double when fwd and la >= 40 and la / lb >= 0.3 then la / lb when bwd and lb >= 40 and lb / la >= 0.3 then lb / la
           else greatest(sh / (na + nb - sh), sh / nb) end as ratio from pr left join de using (a) where death is null or b <= death),
    ov as (select session_id, file_path, a as edit_a_index, b as edit_b_index, ta, tb, tier, round(ratio, 6) as ratio from tr where tier is not null)"""


@query("edit_lineage", f"with {LIN} select session_id, file_path, edit_a_index, edit_b_index, tier, ratio from ov")
def edit_lineage(spark, folder):
    """Documents as successive edits of a (source, language) file, whole texts."""
    found = E.overlaps(E.prepare(document_edits(spark, folder)), write_stage)
    return tidy(found.select("session_id", "file_path", "edit_a_index", "edit_b_index", "tier", "ratio"))


def _context(spark, folder):
    j = table(spark, folder, "labels").join(documents(spark, folder).select("doc_id", "source"), "doc_id")
    base = j.select(F.col("source").alias("session_id"), F.col("doc_id").alias("msg_index"), "toxic", "quality")
    return base.where("toxic = 1").select("session_id", "msg_index", F.lit("error").alias("kind")).unionByName(
        base.where("quality = 0").select("session_id", "msg_index", F.lit("unhappy").alias("kind")))


DEPTHS = """ed as (select distinct session_id, edit_a_index as a, edit_b_index as b from ov),
    walk as (select session_id, b, 1 as depth from ed union select ed.session_id, ed.b, walk.depth + 1 from walk join ed on walk.session_id = ed.session_id and walk.b = ed.a),
    dp as (select session_id, b as edit_index, max(depth)::bigint as depth from walk group by all)"""
CLS = f"""recursive {LIN}, {DEPTHS}, cx as (select source as session_id, doc_id as i, toxic, quality from labels join documents using (doc_id)),
    k as (select ov.*, coalesce(dp.depth, 0) + 1 as depth,
          exists (select 1 from cx where cx.session_id = ov.session_id and toxic = 1 and i > edit_a_index and i < edit_b_index) as err,
          exists (select 1 from cx where cx.session_id = ov.session_id and quality = 0 and i > edit_a_index and i < edit_b_index) as unhappy
          from ov left join dp on dp.session_id = ov.session_id and dp.edit_index = ov.edit_a_index),
    c as (select *, case when depth > 3 then 'iterative_refinement' when ta = tb then case when err then 'error_recovery' else 'self_correction' end
          when unhappy then 'user_directed' else 'iterative_refinement' end as classification from k)"""


def _classified(spark, folder):
    edits = E.prepare(document_edits(spark, folder))
    found = write_stage(E.overlaps(edits, write_stage), "overlaps")
    return edits, E.classify_overlaps(found, _context(spark, folder), E.chain_depths(found))


@query("edit_classes", f"with {CLS} select session_id, tier, classification, count(*)::bigint as n from c group by all")
def edit_classes(spark, folder):
    """Errors and unhappy messages come from the labels."""
    return _classified(spark, folder)[1].groupBy("session_id", "tier", "classification").agg(F.count(F.lit(1)).alias("n"))


@query("edit_metrics", f"""with {CLS}, e as (select session_id, task_id, count_if(not wr)::bigint as edit_count, count_if(wr)::bigint as write_count, count_if(ra)::bigint as replace_all_count,
        count(distinct file_path)::bigint as files_edited from ed0 group by all),
    o as (select session_id, tb as task_id, count(*) as n, count_if(classification = 'self_correction') as sc, count_if(classification = 'error_recovery') as er,
          count_if(classification = 'user_directed') as uc, count_if(classification = 'iterative_refinement') as ir, max(depth) as md from c group by all),
    fl as (select source as session_id, source || '-' || (doc_id // 200) as task_id, bool_or(n_chars % 50 = 0) as sub,
           count_if({hit('text', r'\b(sed|tee)\b')} or regexp_matches(text, '[\\p{{L}}\\p{{N}}_](>>|>\\s)[\\p{{L}}\\p{{N}}_]'))::bigint as mods from documents group by all)
    select e.session_id, e.task_id, edit_count, write_count, replace_all_count, files_edited, coalesce(n, 0)::bigint as overlap_count, coalesce(sc, 0)::bigint as self_corrections,
           coalesce(er, 0)::bigint as error_recoveries, coalesce(uc, 0)::bigint as user_corrections, coalesce(ir, 0)::bigint as iterative_refinements, coalesce(md, 0)::bigint as max_chain_depth,
           mods as bash_file_mod_count, sub as has_subagent_edits,
           round((coalesce(sc, 0) * 3 + coalesce(er, 0) * 2 + coalesce(uc, 0) * 5 + coalesce(md, 0)) / (edit_count + write_count), 6) as triage_score
    from e left join o on e.session_id = o.session_id and e.task_id = o.task_id join fl on fl.session_id = e.session_id and fl.task_id = e.task_id""")
def edit_metrics(spark, folder):
    """A18, A19, C20 per task, with the depth of its chains. Every document is also taken as a shell command."""
    edits, classified = _classified(spark, folder)
    block = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 200).cast("string")).alias("task_id")
    docs = documents(spark, folder).select(F.col("source").alias("session_id"), block, F.col("text").alias("command"), "n_chars")
    tasks = docs.groupBy("session_id", "task_id").agg(F.bool_or(F.col("n_chars") % 50 == 0).alias("used_subagents"))
    return tidy(E.edit_metrics(edits, classified, flags=E.task_flags(docs, tasks)).select(
        "session_id", "task_id", "edit_count", "write_count", "replace_all_count", "files_edited", "overlap_count", "self_corrections", "error_recoveries",
        "user_corrections", "iterative_refinements", "max_chain_depth", "bash_file_mod_count", "has_subagent_edits", "triage_score"))


@query("edit_bins", f"""with {CLS}, e as (select session_id, count_if(not wr)::bigint as edits, count(*) as ops from ed0 group by all),
    o as (select session_id, count(*) as n, count_if(classification = 'self_correction') as sc, count_if(classification = 'iterative_refinement') as ir from c group by all)
    select e.session_id, edits, round(coalesce(sc, 0) / ops, 6) as self_correction_rate, round(coalesce(ir, 0) / ops, 6) as iterative_refinement_rate
    from e left join o using (session_id)""")
def edit_bins(spark, folder):
    """A17 rates per bin, J4."""
    edits, classified = _classified(spark, folder)
    return tidy(E.bin_rates(E.edit_metrics(edits, classified), ["session_id"]).select(
        "session_id", "edits", "self_correction_rate", "iterative_refinement_rate"))


@query("edit_chain_depth", f"with recursive {LIN}, {DEPTHS} select * from dp")
def edit_chain_depth(spark, folder):
    """W25."""
    return tidy(E.chain_depths(E.overlaps(E.prepare(document_edits(spark, folder)), write_stage)))


@query("edit_signals", f"""with {EDITS}, d as (select session_id, doc_id // 200 as task_n, file_path, doc_id, old, new from ed0),
    s as (select session_id, task_n, count(*) as n from d b where old <> '' and exists (select 1 from d a where a.session_id = b.session_id and a.task_n = b.task_n and a.file_path = b.file_path
          and a.doc_id < b.doc_id and a.new <> '' and (contains(b.old, a.new) or contains(a.new, b.old))) group by all),
    er as (select d.session_id, d.task_n, count(*) as n from d where exists (select 1 from labels l join documents x using (doc_id) where l.toxic = 1 and x.source = d.session_id
           and x.doc_id // 200 = d.task_n and d.doc_id - x.doc_id between 1 and 10) group by all),
    f as (select session_id, task_n, file_path, count(*) as n from d group by all),
    t as (select session_id, task_n, sum(n) as events, max(n)::bigint as max_chain_depth from f group by all),
    u as (select source as session_id, doc_id // 200 as task_n, lower(arg_max(text, doc_id)) as m from documents group by all)
    select t.session_id, t.task_n, coalesce(s.n, 0)::bigint as self_corrections, coalesce(er.n, 0)::bigint as error_recoveries, max_chain_depth,
           {count_hits('m', P.CORRECTION_WORDS)}::bigint as user_corrections,
           round(coalesce(s.n, 0) / events, 6) as rewrite_rate from t left join s using (session_id, task_n) left join er using (session_id, task_n) join u using (session_id, task_n)""")
def edit_signals(spark, folder):
    """C8, J10. The last text of a task stands for the message that follows it."""
    docs = documents(spark, folder)
    block = F.floor(F.col("doc_id") / 200)
    events = document_edits(spark, folder).withColumn("task_n", F.floor(F.col("msg_index") / 200))
    errors = docs.join(table(spark, folder, "labels").where("toxic = 1"), "doc_id").select(
        F.col("source").alias("session_id"), block.alias("task_n"), F.col("doc_id").alias("msg_index"))
    tasks = docs.groupBy(F.col("source").alias("session_id"), block.alias("task_n")).agg(F.max_by("text", "doc_id").alias("next_user_message"))
    return tidy(E.edit_signals(events, errors, tasks))


# --- tests ---------------------------------------------------------------------------------
DOC_CFG = Measurements(
    categorical=("lang", "toxic"), continuous=("n_chars",),
    proportions={"good_rate": ("quality", "1"), "toxic_rate": ("toxic", "1")},
    cross_cuts=(CrossCut("overall"), CrossCut("quality", "quality", ("0", "1"))),
    themes={"text": ("lang", "n_chars"), "labels": ("toxic", "good_rate", "toxic_rate")})


def labelled(spark, folder):
    return documents(spark, folder).join(table(spark, folder, "labels"), "doc_id").select(
        cohort("doc_id"), "lang", "source", "n_chars", F.col("toxic").cast("string").alias("toxic"),
        F.col("quality").cast("string").alias("quality"))


LAB = f"""l as (select {parity('doc_id')} as cohort, lang, source, n_chars, toxic::varchar as toxic, quality::varchar as quality from documents join labels using (doc_id)),
    sl as (select *, 'overall' as slice from l union all select *, 'quality:' || quality from l)"""


@query("chi_square", f"""with {LAB}, u as (select slice, cohort, 'lang' as field, lang as v from sl union all select slice, cohort, 'toxic', toxic from sl),
    c as (select slice, field, v, count_if(cohort = 'a') as oa, count_if(cohort = 'b') as ob from u group by all),
    t as (select slice, field, sum(oa) as na, sum(ob) as nb, count(*) as k from c group by all),
    e as (select c.*, na, nb, k, (oa + ob) * na / (na + nb) as ea, (oa + ob) * nb / (na + nb) as eb from c join t using (slice, field) where k >= 2),
    x as (select slice, field, k, na, nb, sum(pow(abs(oa - ea) - case when k = 2 then least(0.5, abs(oa - ea)) else 0 end, 2) / ea
          + pow(abs(ob - eb) - case when k = 2 then least(0.5, abs(ob - eb)) else 0 end, 2) / eb) as chi2, min(least(ea, eb)) < 5 as low_expected from e group by all)
    select slice, field, round(chi2, 6) as statistic, (k - 1)::bigint as dof, round(sqrt(chi2 / (na + nb)), 6) as effect, na::bigint as n_a, nb::bigint as n_b, low_expected from x""")
def chi_square(spark, folder):
    """T1, T2, T13."""
    df = labelled(spark, folder)
    out = AB.chi_square(AB.contingency(df, ("a", "b"), DOC_CFG))
    return tidy(out.select("slice", "field", "statistic", "dof", "effect", "n_a", "n_b", "low_expected"))


ORDER_CFG = Measurements(
    categorical=(), continuous=("o_totalprice", "o_weekday"), proportions={},
    cross_cuts=(CrossCut("overall"), CrossCut("priority", "o_orderpriority", ("1-URGENT", "2-HIGH", "5-LOW"))))


def priced_orders(spark, folder):
    return table(spark, folder, "orders").where("o_orderstatus in ('F', 'O')").select(
        F.col("o_orderstatus").alias("cohort"), "o_orderpriority", "o_totalprice", F.dayofweek("o_orderdate").alias("o_weekday"))


@query("mann_whitney", """with o as (select o_orderstatus as c, o_orderpriority as p, o_totalprice as price, (dayofweek(o_orderdate) + 1)::double as wd from orders where o_orderstatus in ('F', 'O')),
    sl as (select *, 'overall' as slice from o union all select *, 'priority:' || p from o where p in ('1-URGENT', '2-HIGH', '5-LOW')),
    u as (select slice, c, 'o_totalprice' as field, price as v from sl union all select slice, c, 'o_weekday', wd from sl),
    r as (select slice, field, c, v, rank() over (partition by slice, field order by v) + (count(*) over (partition by slice, field, v) - 1) / 2 as rk from u),
    t as (select slice, field, sum(n * n * n - n)::double as ties from (select slice, field, v, count(*)::double as n from u group by all) group by all),
    g as (select slice, field, count_if(c = 'F') as na, count_if(c = 'O') as nb, sum(case when c = 'F' then rk end) as ra, avg(case when c = 'F' then v end) as ma, avg(case when c = 'O' then v end) as mb,
          stddev_samp(case when c = 'F' then v end) as sa, stddev_samp(case when c = 'O' then v end) as sb, median(case when c = 'F' then v end) as da, median(case when c = 'O' then v end) as db from r group by all)
    select slice, field, round(ra - na * (na + 1) / 2, 4) as statistic, round((ma - mb) / sqrt(((na - 1) * sa * sa + (nb - 1) * sb * sb) / (na + nb - 2)), 6) as effect,
           na::bigint as n_a, nb::bigint as n_b, round(ties, 4) as ties, round(ma, 4) as mean_a, round(mb, 4) as mean_b, round(sa, 4) as std_a, round(sb, 4) as std_b,
           round(da, 4) as median_a, round(db, 4) as median_b from g join t using (slice, field)""")
def mann_whitney(spark, folder):
    """T3, T7."""
    out = AB.mann_whitney(priced_orders(spark, folder), ("F", "O"), ORDER_CFG).drop("test")
    return tidy(out.select(
        "slice", "field", F.round("statistic", 4).alias("statistic"), "effect", "n_a", "n_b",
        *[F.round(c, 4).alias(c) for c in ("ties", "mean_a", "mean_b", "std_a", "std_b", "median_a", "median_b")]))


def wilson_sql(x: str, n: str) -> tuple[str, str]:
    z2 = "3.8416::double"
    centre = f"(({x}) / ({n}) + {z2} / (2 * ({n}))) / (1 + {z2} / ({n}))"
    spread = f"1.96::double * sqrt((({x}) / ({n}) * (1 - ({x}) / ({n})) + {z2} / (4 * ({n}))) / ({n})) / (1 + {z2} / ({n}))"
    return f"greatest(0.0::double, {centre} - {spread})", f"least(1.0::double, {centre} + {spread})"


@query("proportion_z", f"""with {LAB}, u as (select slice, cohort, 'good_rate' as field, quality = '1' as h from sl union all select slice, cohort, 'toxic_rate', toxic = '1' from sl),
    g as (select slice, field, count_if(cohort = 'a')::double as na, count_if(cohort = 'b')::double as nb, count_if(cohort = 'a' and h)::double as xa, count_if(cohort = 'b' and h)::double as xb from u group by all),
    s as (select *, sqrt((xa + xb) / (na + nb) * (1 - (xa + xb) / (na + nb)) * (1 / na + 1 / nb)) as se from g)
    select slice, field, round(case when se > 0 then (xa / na - xb / nb) / se else 0 end, 6) as statistic,
           round(2 * asin(sqrt(xa / na)) - 2 * asin(sqrt(xb / nb)), 6) as effect, na::bigint as n_a, nb::bigint as n_b, xa::bigint as x_a, xb::bigint as x_b,
           round(xa / na, 6) as proportion_a, round({wilson_sql('xa', 'na')[0]}, 6) as ci_lower_a, round({wilson_sql('xa', 'na')[1]}, 6) as ci_upper_a,
           round(xb / nb, 6) as proportion_b, round({wilson_sql('xb', 'nb')[0]}, 6) as ci_lower_b, round({wilson_sql('xb', 'nb')[1]}, 6) as ci_upper_b from s""")
def proportion_z(spark, folder):
    """T4-T6, P26."""
    return tidy(AB.proportions(labelled(spark, folder), ("a", "b"), DOC_CFG).drop("test"))


@query("bh_bonferroni", """with p as (select o_orderkey, (o_orderkey * 7919 % 99991) / 99991.0::double as u from orders),
    q as (select o_orderkey, u * u * u * u as p from p),
    r as (select *, row_number() over (order by p) as i, count(*) over () as m from q),
    a as (select *, min(p * m / i) over (order by i desc rows unbounded preceding) as adj from r)
    select o_orderkey, round(least(min(adj) over (partition by p), 1.0::double), 9) as p_adjusted, p < 0.05::double / m as bonferroni_significant,
           least(min(adj) over (partition by p), 1.0::double) < 0.05 as fdr_significant from a""")
def bh_bonferroni(spark, folder):
    """One p-value per order."""
    u = (F.col("o_orderkey") * 7919 % 99991) / F.lit(99991.0)
    p = table(spark, folder, "orders").select("o_orderkey", u.alias("u")).select(
        "o_orderkey", (F.col("u") * F.col("u") * F.col("u") * F.col("u")).alias("p_value"))
    return tidy(AB.adjust(p).select("o_orderkey", "p_adjusted", "bonferroni_significant", "fdr_significant"), 9)


def upper_gamma(a: str, x: str) -> str:
    """SQL of the regularised upper incomplete gamma function by the series of its complement; 1 for x <= 0."""
    return (f"case when {x} > 0 then greatest(0, 1 - list_sum(list_transform(range(1500), "
            f"lambda n: exp(({a} + n) * ln({x}) - ({x}) - lgamma({a} + n + 1))))) else 1 end")


LABEL = "case when effect is null then 'n/a' when abs(effect) < 0.2 then 'negligible' when abs(effect) < 0.5 then 'small' when abs(effect) < 0.8 then 'medium' else 'large' end"
ALL_TESTS = f"""{LAB}, cu as (select slice, cohort, 'lang' as field, lang as v from sl union all select slice, cohort, 'toxic', toxic from sl),
    cc as (select slice, field, v, count_if(cohort = 'a') as oa, count_if(cohort = 'b') as ob from cu group by all),
    ct as (select slice, field, sum(oa) as na, sum(ob) as nb, count(*) as k from cc group by all),
    ce as (select cc.*, na, nb, k, (oa + ob) * na / (na + nb) as ea, (oa + ob) * nb / (na + nb) as eb from cc join ct using (slice, field) where k >= 2 and na > 0 and nb > 0),
    cx as (select slice, field, k, na, nb, sum(pow(abs(oa - ea) - case when k = 2 then least(0.5, abs(oa - ea)) else 0 end, 2) / ea
           + pow(abs(ob - eb) - case when k = 2 then least(0.5, abs(ob - eb)) else 0 end, 2) / eb) as s from ce group by all),
    nr as (select slice, cohort, n_chars::double as v, rank() over (partition by slice order by n_chars) + (count(*) over (partition by slice, n_chars) - 1) / 2 as rk from sl),
    nt as (select slice, sum(n * n * n - n)::double as ties from (select slice, v, count(*)::double as n from nr group by all) group by all),
    ng as (select slice, count_if(cohort = 'a') as na, count_if(cohort = 'b') as nb, sum(case when cohort = 'a' then rk end) as ra, avg(case when cohort = 'a' then v end) as ma, avg(case when cohort = 'b' then v end) as mb,
           var_samp(case when cohort = 'a' then v end) as va, var_samp(case when cohort = 'b' then v end) as vb, median(case when cohort = 'a' then v end) as da, median(case when cohort = 'b' then v end) as db from nr group by all),
    nx as (select *, ra - na * (na + 1) / 2 as u, (greatest(ra - na * (na + 1) / 2, na * nb - ra + na * (na + 1) / 2) - na * nb / 2 - 0.5)
           / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb)::double * (na + nb - 1)))) as z from ng join nt using (slice)),
    pu as (select slice, cohort, 'good_rate' as field, quality = '1' as h from sl union all select slice, cohort, 'toxic_rate', toxic = '1' from sl),
    pg as (select slice, field, count_if(cohort = 'a')::double as na, count_if(cohort = 'b')::double as nb, count_if(cohort = 'a' and h)::double as xa, count_if(cohort = 'b' and h)::double as xb from pu group by all),
    ps as (select *, sqrt((xa + xb) / (na + nb) * (1 - (xa + xb) / (na + nb)) * (1 / na + 1 / nb)) as se from pg),
    px as (select *, case when se > 0 then (xa / na - xb / nb) / se else 0 end as z from ps),
    raw as (select slice, field, 'chi-square' as test, s as statistic, sqrt(s / (na + nb)) as effect, {upper_gamma('((k - 1) / 2)', '(s / 2)')} as p, na, nb,
                   null::double as ma, null::double as mb, null::double as pa, null::double as pb from cx
            union all select slice, 'n_chars', 'mann-whitney-u', u, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)),
                   case when z > 0 then {upper_gamma('0.5::double', '(z * z / 2)')} else 1 end, na, nb, da, db, null, null from nx
            union all select slice, field, 'two-proportion-z', z, 2 * asin(sqrt(xa / na)) - 2 * asin(sqrt(xb / nb)), {upper_gamma('0.5::double', '(z * z / 2)')}, na, nb,
                   null, null, xa / na, xb / nb from px),
    br as (select *, row_number() over (order by p) as i, count(*) over () as m from raw),
    ba as (select *, min(p * m / i) over (order by i desc rows unbounded preceding) as adj from br),
    bt as (select *, least(min(adj) over (partition by p), 1.0::double) as q, {LABEL} as label,
           case field when 'lang' then 'text' when 'n_chars' then 'text' else 'labels' end as theme from ba)"""


@query("ab_tests", f"""with {ALL_TESTS} select slice, field, test, round(statistic, 4) as statistic, round(effect, 6) as effect, label as effect_label, round(p, 7) as p_value, round(q, 7) as p_adjusted,
    p < 0.05 as significant_p05, p < 0.05::double / m as bonferroni_significant, q < 0.05 as fdr_significant, theme, na::bigint as n_a, nb::bigint as n_b,
    round(ma, 4) as median_a, round(mb, 4) as median_b, round(pa, 6) as proportion_a, round(pb, 6) as proportion_b from bt""")
def ab_tests(spark, folder):
    """T1-T8, T11-T14, J18 with p-values."""
    tests = AB.adjust(AB.run_tests(labelled(spark, folder), ("a", "b"), DOC_CFG))
    return tidy(tests.select(
        "slice", "field", "test", "effect_label", "significant_p05", "bonferroni_significant", "fdr_significant", "theme", "n_a", "n_b",
        *[F.round(c, k).alias(c) for k, names in ((4, ("statistic", "median_a", "median_b")), (6, ("effect", "proportion_a", "proportion_b")),
                                                  (7, ("p_value", "p_adjusted"))) for c in names]), 9)


@query("findings_rank", f"""with {ALL_TESTS}, d as (select *, replace(field, '_', ' ') as f, printf('h=%.2f', abs(effect)) as h from bt)
    select row_number() over (order by q < 0.05 desc, coalesce(abs(effect), 0) desc, slice, field, test)::bigint as rank, field, test as test_type, slice as cross_cut, theme,
    round(p, 7) as p_value, round(q, 7) as p_adjusted, q < 0.05 as fdr_significant, p < 0.05::double / m as bonferroni_significant, round(abs(effect), 6) as effect_size, label as effect_label,
    case test when 'chi-square' then 'distributions differ' when 'mann-whitney-u' then case when mb > ma then 'b higher' when ma > mb then 'a higher' else 'equal' end
         else case when pb > pa then 'b higher' when pa > pb then 'a higher' else 'equal' end end as direction,
    case when test = 'chi-square' then f || printf(' distributions differ (V=%.2f, ', effect) || label || ')'
         when test = 'mann-whitney-u' and mb > ma then 'B has higher ' || f || printf(' (median %.1f vs %.1f, d=%.2f)', mb, ma, abs(effect))
         when test = 'mann-whitney-u' and ma > mb then 'A has higher ' || f || printf(' (median %.1f vs %.1f, d=%.2f)', ma, mb, abs(effect))
         when pb > pa then f || printf(': B %.1f%% vs A %.1f%% (', pb * 100, pa * 100) || h || ')'
         when pa > pb then f || printf(': A %.1f%% vs B %.1f%% (', pa * 100, pb * 100) || h || ')'
         else 'No significant difference in ' || f end as narrative from d""")
def findings_rank(spark, folder):
    """T17, T18, W28."""
    tests = AB.adjust(AB.run_tests(labelled(spark, folder), ("a", "b"), DOC_CFG))
    found = FI.findings(tests, ("a", "b")).drop("values")
    return tidy(found.withColumns({"effect_size": F.round("effect_size", 6), "p_value": F.round("p_value", 7), "p_adjusted": F.round("p_adjusted", 7)}), 9)


SENS = f"""p as (select {parity('n_chars')} as cohort, source || '/' || lang as prj, quality, toxic from documents join labels using (doc_id)),
    sh as (select prj from p where cohort = 'a' intersect select prj from p where cohort = 'b'),
    a as (select 'full' as run, * from p union all select 'restricted', * from p where prj in (select prj from sh)),
    u as (select run, cohort, 'good_rate' as field, quality = 1 as h from a union all select run, cohort, 'toxic_rate', toxic = 1 from a),
    g as (select run, field, count_if(cohort = 'a')::double as na, count_if(cohort = 'b')::double as nb, count_if(cohort = 'a' and h)::double as xa, count_if(cohort = 'b' and h)::double as xb from u group by all),
    z as (select run, field, xa / na - xb / nb as d, (xa / na - xb / nb) / sqrt((xa + xb) / (na + nb) * (1 - (xa + xb) / (na + nb)) * (1 / na + 1 / nb)) as z from g),
    w as (select f.field, f.d as fd, r.d as rd, abs(f.z) > 1.959963984540054 as fs, abs(r.z) > 1.959963984540054 as rs,
          case when f.d <> 0 and r.d <> 0 then (f.d > 0) = (r.d > 0) else true end as same from z f join z r on f.field = r.field and f.run = 'full' and r.run = 'restricted')"""


@query("sensitivity", f"""with {SENS} select 'overall' as slice, field, round(fd, 6) as full_diff, round(rd, 6) as restricted_diff, fs as full_significant, rs as restricted_significant,
        case when fs = rs and same then 'agree' when same and not (fs and rs) then 'weak' else 'DIVERGE' end as agreement from w""")
def sensitivity(spark, folder):
    """T15, J11, J15."""
    cfg = Measurements(categorical=(), continuous=(), proportions=DOC_CFG.proportions, cross_cuts=(CrossCut("overall"),))
    df = labelled(spark, folder).withColumn("cohort", cohort("n_chars")).withColumn(
        "project_path", F.concat_ws("/", "source", "lang"))
    full = AB.run_tests(df, ("a", "b"), cfg)
    narrow = AB.run_tests(AB.restricted(df, ("a", "b")), ("a", "b"), cfg)
    return tidy(AB.sensitivity(full, narrow).select(
        "slice", "field", "full_diff", "restricted_diff", "full_significant", "restricted_significant", "agreement"))


def drawn(rows: str, keys: str, values: list[str], resamples: int) -> str:
    """SQL of the resample sums: the counter hash over MD5 words, Poisson weights, weighted sums by (keys, b)."""
    mask = 4294967295
    weight = " + ".join(f"(h >= {t})::int" for t in BS.POISSON)
    return f"""w0 as (select *, ('0x' || substr(md5(ident || ':42'), 1, 8))::ubigint as lo, ('0x' || substr(md5(ident || ':42'), 9, 8))::ubigint as hi from {rows}),
    w1 as (select {keys}, {', '.join(values)}, hi, b, (lo + b::ubigint * {BS.STEP}) & {mask} as h from w0, range(1, {resamples + 1}) r(b)),
    w2 as (select * replace (xor(h, h >> 16) * {BS.FIRST} & {mask} as h) from w1),
    w3 as (select * replace (xor(xor(h, h >> 13), hi) * {BS.SECOND} & {mask} as h) from w2),
    w4 as (select * exclude (h, hi), {weight.replace('h >=', 'xor(h, h >> 16) >=')} as w from w3),
    dr as (select {keys}, b, sum(w) as w, {', '.join(f'sum(w * {v}) as {v}' for v in values)} from w4 group by all)"""


@query("bootstrap_mean", f"""with o as (select o_orderstatus, o_totalprice::double as v, o_orderkey::varchar as ident from orders),
    {drawn('o', 'o_orderstatus', ['v'], 5000)},
    q as (select o_orderstatus, quantile_cont(v / w, 0.025) as lo, quantile_cont(v / w, 0.975) as hi from dr where w > 0 group by all),
    n as (select o_orderstatus, count(*) as n, avg(v) as mean from o group by all)
    select o_orderstatus, n::bigint as n, round(mean, 4) as mean, round(lo, 4) as ci_lower, round(hi, 4) as ci_upper from n join q using (o_orderstatus)""")
def bootstrap_mean(spark, folder):
    """Interval of the mean order price."""
    return tidy(BS.mean_interval(table(spark, folder, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderkey"), 4)


@query("token_intervals", f"""with t as (select {parity('l_orderkey')} as cohort, l_returnflag as complexity, l_linestatus as type, l_orderkey || '-' || l_linenumber as ident,
        (l_extendedprice / 1000)::double as cost, floor(l_extendedprice)::double as outp, floor(l_extendedprice)::double / l_linenumber as per from lineitem),
    {drawn('t', 'cohort, complexity, type', ['cost', 'outp', 'per'], 2000)},
    g as (select cohort, b, 'overall' as "grouping", 'all' as group_value, sum(w) as w, sum(cost) as cost, sum(outp) as outp, sum(per) as per from dr group by all
          union all select cohort, b, 'complexity', complexity, sum(w), sum(cost), sum(outp), sum(per) from dr group by all
          union all select cohort, b, 'type', type, sum(w), sum(cost), sum(outp), sum(per) from dr group by all),
    s as (select cohort, "grouping", group_value, list_sort(list(cost / w)) as c, list_sort(list(outp / w)) as o, list_sort(list(per / w)) as p from g where w > 0 group by all)
    select cohort, "grouping", group_value, {', '.join(f"round({v}[floor(len({v}) * {p}::double)::int + 1], 4) as {name}_ci_{e}" for v, name in (('c', 'cost'), ('o', 'output_tokens'), ('p', 'per_request')) for p, e in ((0.025, 'lower'), (0.975, 'upper')))} from s""")
def token_intervals(spark, folder):
    """Bootstrap intervals of the token report over the grouping sets."""
    report = TOK.token_report(line_tasks(spark, folder), LEVELS)
    return tidy(report.select("cohort", "grouping", "group_value", *[
        f"{name}_ci_{e}" for name in ("cost", "output_tokens", "per_request") for e in ("lower", "upper")]), 4)


@query("bootstrap_median", """with o as (select o_orderstatus as s, o_totalprice::double as v, row_number() over (partition by o_orderstatus order by o_totalprice) - 1 as i from orders),
    n as (select s, count(*) as n, median(v) as median from o group by all),
    k as (select s, n, unnest(range(greatest(1, (n / 2 - 3 * sqrt(n))::bigint), least(n, (n / 2 + 3 * sqrt(n))::bigint + 1))) as k from n),
    j as (select *, unnest(range(n // 2 + 1, n + 1)) as j from k),
    t as (select s, k, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n) + (n - j) * ln(1 - k / n))) as tail from j group by all),
    r as (select s, min(k) filter (tail >= 0.025) - 1 as lo, min(k) filter (tail >= 0.975) - 1 as hi from t group by all)
    select n.s as o_orderstatus, n::bigint as n, round(median, 4) as median, round((select v from o where o.s = r.s and i = lo), 4) as ci_lower,
           round((select v from o where o.s = r.s and i = hi), 4) as ci_upper from n join r using (s)""")
def bootstrap_median(spark, folder):
    """Interval of the median order price; the SQL sums the binomial tail term by term."""
    return tidy(BS.median_interval(table(spark, folder, "orders"), ["o_orderstatus"], "o_totalprice"), 4)


@query("stratified_sample", """with d as (select doc_id, lang, source, md5(doc_id || ':42') as h from documents where n_chars > 20),
    z as (select source, count(*) as size from d group by all),
    w as (select *, sum(size) over () as total, ceil(0.1::double * sum(size) over ())::bigint as n from z),
    b as (select *, (n::hugeint * size) // total as part, ((n::hugeint * size) % total)::double as over from w),
    q as (select *, greatest(part, 1) + (row_number() over (order by case when part > 0 then over else 0 end desc, source is null, source)
          <= n - sum(greatest(part, 1)) over ())::int as quota from b),
    r as (select d.*, quota, row_number() over (partition by d.source order by h, doc_id) as place from d join q on d.source is not distinct from q.source)
    select doc_id, lang, source from r where place <= quota""")
def stratified_sample(spark, folder):
    """A tenth of the documents that hold something, proportional per source."""
    docs = documents(spark, folder)
    picked = AB.stratified_sample(docs, "source", "doc_id", share=0.1, eligible=F.col("n_chars") > 20)
    return picked.select("doc_id", "lang", "source")


# --- publication -----------------------------------------------------------------------------
@query("anonymise", """with p as (select page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages),
    l as (select host, row_number() over (order by host) as n from (select distinct host from p))
    select page_id, 'project-' || case when n < 10 then '0' || n else n::varchar end as project_path,
           replace(url, host, 'project-' || case when n < 10 then '0' || n else n::varchar end) as url from p join l using (host)""")
def anonymise(spark, folder):
    """The host of a page is its project."""
    pages = table(spark, folder, "pages").select(
        "page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("project_path"))
    return PB.anonymise(pages, PB.project_labels([pages]), ["url"], "/home/someone", path_column=None).select(
        "page_id", "project_path", "url")


@query("public_aggregates", f"""with t as (select {parity('doc_id')} as cohort, lang, source, case when n_chars % 3 = 0 then 'Satisfied user' when n_chars % 3 = 1 then 'dissatisfied' else 'unclear' end as s,
        case when n_chars % 2 = 0 then 'complete' else 'Partial' end as c from documents),
    u as (select cohort, 'outcome' as measure, lang as value from t union all select cohort, 'complexity', source from t union all select cohort, 'type', lang from t
          union all select cohort, 'sentiment', case when s = 'dissatisfied' then 'dissatisfied' when s = 'unclear' then 'neutral' else 'satisfied' end from t
          union all select cohort, 'completion', lower(c) from t)
    select cohort, measure, value, count(*)::bigint as count, round(100.0 * count(*) / sum(count(*)) over (partition by cohort, measure), 6) as pct from u group by cohort, measure, value""")
def public_aggregates(spark, folder):
    """A22, C21, S11."""
    n = F.col("n_chars")
    docs = documents(spark, folder).select(
        cohort("doc_id"), F.col("lang").alias("outcome_category"),
        F.struct(F.col("source").alias("complexity"), F.col("lang").alias("type")).alias("classification"),
        F.when(n % 3 == 0, "Satisfied user").when(n % 3 == 1, "dissatisfied").otherwise("unclear").alias("user_sentiment"),
        F.when(n % 2 == 0, "complete").otherwise("Partial").alias("task_completion"))
    return tidy(PB.public_aggregates(docs, docs))


@query("consistency", f"""with b as (select {parity('doc_id')} as cohort, count(*) as included from documents group by all),
    c as (select 'labels' as output, {parity('doc_id')} as cohort, count(*) as n from labels group by all
          union all select 'pages', {parity('page_id')}, count(*) from pages group by all union all select 'events', {parity('event_id')}, count(*) from events group by all)
    select cohort, output, n::bigint as n, included::bigint as included, case when n <= 0 then 'empty' when n > included then 'too_many' else 'ok' end as status from c left join b using (cohort)""")
def consistency(spark, folder):
    """A39."""
    base = documents(spark, folder).groupBy(cohort("doc_id")).agg(F.count(F.lit(1)).alias("included"))
    parts = None
    for name, ident in (("labels", "doc_id"), ("pages", "page_id"), ("events", "event_id")):
        one = table(spark, folder, name).groupBy(cohort(ident)).agg(F.count(F.lit(1)).alias("n")).withColumn("output", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return D.consistency(parts, base).select("cohort", "output", "n", "included", "status")


@query("common_items", """with w as (select c.o_orderstatus, unnest([o_orderpriority, 'Status ' || o_orderstatus, ' customer ' || o_custkey % 7]) as item from orders c),
    n as (select o_orderstatus, lower(trim(item)) as item, count(*)::bigint as count from w group by all),
    r as (select *, row_number() over (partition by o_orderstatus order by count desc, item) as rank from n) select * from r where rank <= 5""")
def common_items(spark, folder):
    """The five most frequent strings over lists, a report."""
    o = table(spark, folder, "orders").select("o_orderstatus", F.array(
        "o_orderpriority", F.concat(F.lit("Status "), "o_orderstatus"),
        F.concat(F.lit(" customer "), (F.col("o_custkey") % 7).cast("string"))).alias("items"))
    return tidy(D.common_items(o, ["o_orderstatus"], "items"))
