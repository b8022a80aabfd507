"""Registered queries over replication, annotation and test summaries, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.operators import abtests as AB
from taskloom.operators import annotate as AN
from taskloom.operators import browse
from taskloom.operators import dataset as D
from taskloom.operators import findings as FI
from taskloom.operators import timing as TM
from taskloom.plans.bindings import cohort, documents
from taskloom.plans.registry import query, table, tidy
from taskloom.plans.table_queries import ALL_TESTS, DOC_CFG, ORDER_SQL, labelled, order_tasks, parity


# --- replication --------------------------------------------------------------
@query("replication_batch", f"""with {ORDER_SQL}, s as (select *, least(tools, 20) / 20 + case when outcome = 'unclear' then 0.5::double else 1.0::double end + least(files, 5) / 5 as score
        from t where tools >= 3 and outcome <> 'unclear' and o_totalprice <= 600000),
    c as (select *, row_number() over (order by score desc, task_id) as number from s qualify number <= 10),
    f as (select distinct l_orderkey, 'part-' || l_partkey as file from lineitem where l_orderkey in (select o_orderkey from c)),
    r as (select l_orderkey, file, row_number() over (partition by l_orderkey order by file) as n from f)
    select number::bigint as number, task_id, tools::bigint as tools, files::bigint as total_files_touched, added::bigint as total_lines_added, removed::bigint as total_lines_removed, outcome as outcome_category,
           (select string_agg(file, ' ' order by file) from r where r.l_orderkey = c.o_orderkey and n <= 3) as files from c""")
def replication_batch(spark, folder):
    """The ten best candidates as a numbered batch, each with its first three files."""
    tasks = order_tasks(spark, folder).withColumns({
        "duration_seconds": F.col("duration_seconds") / 1000, "read_calls": F.lit(0), "session_id": F.col("l_orderkey"),
        "task_n": F.lit(1), "user_prompt": F.lit("")})
    chosen = browse.replication_candidates(tasks)
    files = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.lit(1).alias("task_n"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("file"))
    rows = browse.replication_rows(chosen, files, 3)
    return tidy(rows.select("number", "task_id", "tools", "total_files_touched", "total_lines_added", "total_lines_removed", "outcome_category",
                            F.array_join("files", " ").alias("files")))


@query("run_efficiency", """with l as (select l_orderkey, count(*) as tools, sum(l_quantity)::bigint as added from lineitem group by all)
    select o_orderkey::varchar as run_id, round(tools / nullif((added + o_custkey % 3)::double / 100, 0), 6) as tools_per_100_lines,
           round((o_totalprice / tools)::double, 6) as seconds_per_tool, round(tools / nullif((o_custkey % 5)::double, 0), 6) as tool_ratio,
           round((o_totalprice / nullif((o_custkey % 7)::double, 0))::double, 6) as duration_ratio, o_orderstatus = 'F' as passed
    from orders join l on l_orderkey = o_orderkey""")
def run_efficiency(spark, folder):
    """An order replayed: its lines are the tools of the second run, its customer number gives the first."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tools"), F.sum("l_quantity").cast("long").alias("added"))
    o = table(spark, folder, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("o_custkey")
    runs = o.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.lit("").alias("task"), F.lit("").alias("model"), F.lit("").alias("original_model"),
        F.struct(F.col("added").alias("lines_added"), (k % 3).alias("lines_removed"), (k % 5).alias("tools"), (k % 7).alias("duration_seconds")).alias("original_metrics"),
        F.struct(F.col("tools").alias("total_tools"), F.col("o_totalprice").cast("double").alias("duration_seconds")).alias("replication_metrics"),
        F.struct((F.col("o_orderstatus") == "F").alias("overall_success")).alias("verification"))
    return tidy(D.run_efficiency(runs).select("run_id", "tools_per_100_lines", "seconds_per_tool", "tool_ratio", "duration_ratio", "passed"))


# --- selections ---------------------------------------------------------------
@query("triage_top", """with s as (select case when user_id % 2 = 0 then 'a' else 'b' end as cohort, user_id, round(sum(value), 4) as score from events group by all),
    r as (select *, row_number() over (partition by cohort order by score desc, user_id) as rank from s where score > 0)
    select cohort, user_id, score::double as score, rank::bigint as rank from r where rank <= 10""")
def triage_top(spark, folder):
    """O1: the ten highest positive scores of each cohort; the sum of a user's values is the score."""
    scores = table(spark, folder, "events").groupBy(cohort("user_id"), "user_id").agg(F.round(F.sum("value"), 4).alias("score"))
    return tidy(TM.top_per_group(scores.where("score > 0"), ["cohort"], [F.desc("score"), F.asc("user_id")], 10), 4)


@query("score_examples", """with d as (select doc_id, lang, n_chars % 6 as score from documents),
    c as (select lang, case when score = 5 then 'high' when score <= 2 then 'low' end as kind, doc_id, score from d),
    r as (select *, row_number() over (partition by lang, kind order by doc_id) as rank from c where kind is not null)
    select lang, kind, doc_id, score::bigint as score, rank::bigint as rank from r where rank <= 2""")
def score_examples(spark, folder):
    """The first two examples of high and of low scores per language."""
    score = F.col("n_chars") % 6
    kinds = documents(spark, folder).select("lang", F.when(score == 5, "high").when(score <= 2, "low").alias("kind"), "doc_id", score.alias("score"))
    return tidy(TM.top_per_group(kinds.where("kind is not null"), ["lang", "kind"], [F.asc("doc_id")], 2))


# --- annotations ----------------------------------------------------------------
NOTES = f"""n as (select doc_id, {parity('doc_id')} as cohort, n_chars % 6 as alignment_score, case n_chars % 5 when 0 then 'Satisfied' when 1 then 'dissatisfied user'
        when 2 then 'neutral' when 3 then 'iterative work' else 'mixed' end as user_sentiment, n_chars % 11 / 2.0::double as lpm, n_chars % 4 as tpf from documents)"""


def notes(spark, folder):
    n = F.col("n_chars")
    mood = F.when(n % 5 == 0, "Satisfied").when(n % 5 == 1, "dissatisfied user").when(n % 5 == 2, "neutral").when(n % 5 == 3, "iterative work").otherwise("mixed")
    return documents(spark, folder).select(
        "doc_id", cohort("doc_id"), (n % 6).alias("alignment_score"), mood.alias("user_sentiment"), (n % 11 / 2).alias("lines_per_minute"),
        (n % 4).alias("tools_per_file"), F.struct(F.when(n % 2 == 0, "satisfied").otherwise("neutral").alias("keyword_sentiment"),
                                                  F.when(n % 3 == 0, "satisfied").otherwise("neutral").alias("llm_sentiment")).alias("signal_agreement"))


@query("annotation_summary", f"""with {NOTES} select cohort, count(*)::bigint as n, round(avg(case when alignment_score > 0 then alignment_score end), 6) as avg_score,
    round(avg(case when lpm > 0 then lpm end), 6) as avg_lines_per_minute, round(avg(case when tpf > 0 then tpf end), 6) as avg_tools_per_file,
    count_if(user_sentiment = 'Satisfied')::bigint as satisfied, count_if(user_sentiment = 'iterative work')::bigint as collaborative, count_if(user_sentiment = 'neutral')::bigint as neutral,
    count_if(user_sentiment = 'dissatisfied user')::bigint as dissatisfied, count_if(user_sentiment = 'mixed')::bigint as other from n group by cohort""")
def annotation_summary(spark, folder):
    """A44, C21."""
    return tidy(D.annotation_summary(notes(spark, folder), ["cohort"]))


@query("signal_agreement", f"""select {parity('doc_id')} as cohort, round(avg((n_chars % 2 = 0) = (n_chars % 3 = 0)), 6) as agreement, count(*)::bigint as n from documents group by all""".replace(
    "avg((n_chars % 2 = 0) = (n_chars % 3 = 0))", "avg(((n_chars % 2 = 0) = (n_chars % 3 = 0))::int)"))
def signal_agreement(spark, folder):
    """A36."""
    return tidy(AN.signal_agreement_rate(notes(spark, folder), ["cohort"]))


@query("complexity_lookup", """select o_orderkey::varchar as task_id, coalesce(max(l_returnflag), 'unknown') as complexity
    from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def complexity_lookup(spark, folder):
    """The greatest return flag is the complexity of an order; orders without lines were never classified."""
    tasks = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"))
    known = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("task_id")).agg(F.max("l_returnflag").alias("complexity"))
    return AN.lookup_complexity(tasks, known)


@query("extraction_summary", f"""with t as (select {parity('o_orderkey')} as cohort, o_orderkey as k, o_custkey as c, o_totalprice::double as p from orders)
    select cohort, count(*)::bigint as tasks, round(avg(c), 6) as avg_input_tokens, round(avg(k), 6) as avg_output_tokens, round(sum(p), 4) as total_cost,
           round(sum(k % 5) / (sum(k % 5) + sum(c % 2)), 6) as edit_success, count_if(k % 3 = 0)::bigint as planning_tasks, count_if(c % 4 = 0)::bigint as subagent_tasks,
           count_if(k % 7 > 0)::bigint as parallel_tasks from t group by all""")
def extraction_summary(spark, folder):
    """A43."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tasks = table(spark, folder, "orders").select(
        cohort("o_orderkey"), c.alias("input_tokens"), k.alias("output_tokens"), F.col("o_totalprice").cast("double").alias("estimated_cost"),
        (k % 5).alias("edit_event_count"), (c % 2).alias("failed_edit_count"), (k % 3 == 0).alias("used_planning"), (c % 4 == 0).alias("used_subagents"),
        (k % 7).alias("parallel_tool_messages"))
    return tidy(D.extraction_summary(tasks, ["cohort"])).withColumn("total_cost", F.round("total_cost", 4))


@query("readiness", """with a as (select lang as area, count(*) as n, min(1.0::double / (1 + n_chars)) as best_p from documents group by all)
    select area, n::bigint as n, round(best_p, 6) as best_p, case area when 'en' then 50 when 'de' then 100000 end::double as needed_n, case area when 'en' then 0.05 when 'de' then 0.05 end::double as needed_p,
           n >= case area when 'en' then 50 when 'de' then 100000 end and best_p <= case area when 'en' then 0.05 when 'de' then 0.05 end as ready from a""")
def readiness(spark, folder):
    """Areas with a threshold are ready or not, others are null."""
    measured = documents(spark, folder).groupBy(F.col("lang").alias("area")).agg(F.count(F.lit(1)).alias("n"), F.min(F.lit(1.0) / (1 + F.col("n_chars"))).alias("best_p"))
    return tidy(D.readiness(measured, {"en": (50, 0.05), "de": (100000, 0.05)}))


# --- test summaries --------------------------------------------------------------
def tests(spark, folder):
    return AB.adjust(AB.run_tests(labelled(spark, folder), ("a", "b"), DOC_CFG))


@query("findings_by_theme", f"""with {ALL_TESTS}, r as (select *, row_number() over (order by q < 0.05 desc, coalesce(abs(effect), 0) desc, slice, field, test) as rank from bt)
    select theme, count_if(q < 0.05)::bigint as significant, count_if(q >= 0.05)::bigint as non_significant,
           coalesce(string_agg(rank, ' ' order by rank) filter (q < 0.05), '') as significant_ranks, round(max(coalesce(abs(effect), 0)), 6) as strongest_effect from r group by theme""")
def findings_by_theme(spark, folder):
    """T19."""
    found = FI.by_theme(FI.findings(tests(spark, folder), ("a", "b")))
    return tidy(found.withColumn("significant_ranks", F.array_join(F.transform("significant_ranks", lambda r: r.cast("string")), " ")))


@query("findings_by_slice", f"""with {ALL_TESTS}, r as (select *, row_number() over (order by q < 0.05 desc, coalesce(abs(effect), 0) desc, slice, field, test) as rank from bt)
    select slice as cross_cut, count_if(q < 0.05)::bigint as significant, count_if(q >= 0.05)::bigint as non_significant,
           coalesce(string_agg(rank, ' ' order by rank) filter (q < 0.05), '') as significant_ranks from r group by slice""")
def findings_by_slice(spark, folder):
    """T19."""
    found = FI.by_cross_cut(FI.findings(tests(spark, folder), ("a", "b")))
    return tidy(found.withColumn("significant_ranks", F.array_join(F.transform("significant_ranks", lambda r: r.cast("string")), " ")))


@query("tests_condensed", f"""with {ALL_TESTS} select split_part(slice, ':', 1) as section, count_if(p < 0.05)::bigint as significant, count_if(p >= 0.05)::bigint as not_significant,
    coalesce(string_agg(slice || ' ' || test || ' ' || field, '; ' order by slice || ' ' || test || ' ' || field) filter (p < 0.05), '') as listed from bt group by all""")
def tests_condensed(spark, folder):
    """A42."""
    return tidy(FI.condensed(tests(spark, folder)).withColumn("listed", F.array_join("listed", "; ")))


@query("measure_by_slice", f"""with {ALL_TESTS} select split_part(slice, ':', 2) as value, round(ma, 4) as median_a, round(mb, 4) as median_b,
    na::bigint as n_a, nb::bigint as n_b from bt where test = 'mann-whitney-u' and slice like 'quality%'""")
def measure_by_slice(spark, folder):
    """The length of documents over the slices of one cut."""
    found = AB.measure_by_slice(tests(spark, folder), "n_chars", "quality")
    return tidy(found.select("value", "median_a", "median_b", "n_a", "n_b"), 4)
