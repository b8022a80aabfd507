"""Scans, intervals, classifiers, publication, sources and browsing on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taskloom.config import Measurements, cohort_pair, pair_from_name
from taskloom.functions import classify as C
from taskloom.functions import outcome as O
from taskloom.functions import signals as G
from taskloom.functions import text as T
from taskloom.operators import browse, publish
from taskloom.operators import intervals as I
from taskloom.operators import scan as S
from taskloom.operators import timing as TM
from taskloom.sources import tables as TB


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_chunked_scan_equals_plain_window(spark, size):
    rng = random.Random(size)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 4)}", i, rng.choice([None, 1, 2, 3]), rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v int, s string")
    got = S.ordered(df, ["k"], ["i"], S.index_chunk("i", size), n=S.position(), t=S.total(F.col("v")), tb=S.total_before(F.col("v")),
                    l=S.latest(F.col("v")), lb=S.latest_before(F.col("v")), nx=S.next_after(F.col("v")), hi=S.highest(F.col("v")),
                    lo=S.lowest_from(F.col("v")), c=S.count_all(), m=S.overall_max(F.col("v")), lag=S.latest_before(F.col("s")))
    w = Window.partitionBy("k").orderBy("i")
    to, before, after = (w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1),
                         w.rowsBetween(1, Window.unboundedFollowing))
    every = Window.partitionBy("k")
    want = df.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.coalesce(F.sum("v").over(to), F.lit(0)).alias("t"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("tb"), F.last("v", True).over(to).alias("l"),
        F.last("v", True).over(before).alias("lb"), F.first("v", True).over(after).alias("nx"), F.max("v").over(to).alias("hi"),
        F.min("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("lo"), F.count("*").over(every).alias("c"),
        F.max("v").over(every).alias("m"), F.lag("s").over(w).alias("lag"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_intervals_equal_brute_force(spark):
    rng = random.Random(2)
    iv = []
    for i in range(60):
        start = rng.randint(0, 400)
        iv.append((f"s{i}", float(start), float(start + rng.choice([0, 1, 5, 30]))))
    df = spark.createDataFrame(iv, "session_id string, start_s double, end_s double")
    real = [x for x in iv if x[2] > x[1]]
    pairs = sum(1 for i, x in enumerate(real) for y in real[i + 1:] if max(x[1], y[1]) < min(x[2], y[2]))
    moments = sorted({x[1] for x in real})
    top = max(sum(x[1] <= m < x[2] for x in real) for m in moments)
    merged = []
    for _s, a, b in sorted(real, key=lambda x: x[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    gaps = [(rng.choice(iv)[0], float(a), float(a + rng.randint(1, 20))) for a in rng.sample(range(0, 430), 40)]
    gdf = spark.createDataFrame(gaps, "session_id string, gap_start_s double, gap_end_s double")
    want = sorted((s, a, "context_switch" if any(x[0] != s and x[1] <= (a + b) / 2 <= x[2] for x in real) else "true_idle")
                  for s, a, b in gaps)
    for width in (3.0, 100.0, 1e6):
        r = I.concurrency(df, width=width).first()
        assert (r.session_count, r.overlapping_pairs, r.max_concurrency) == (len(real), pairs, top)
        got = sorted([r.period_start, r.period_end] for r in I.activity_periods(df, width=width).collect())
        assert got == merged
        assert sorted((r.session_id, r.gap_start_s, r.gap_class) for r in I.classify_gaps(gdf, df, width).collect()) == want
    for cut in ({"rows": 6}, {}):  # borders that follow the data
        r = I.concurrency(df, **cut).first()
        assert (r.session_count, r.overlapping_pairs, r.max_concurrency) == (len(real), pairs, top)
        assert sorted([r.period_start, r.period_end] for r in I.activity_periods(df, **cut).collect()) == merged
        assert sorted((r.session_id, r.gap_start_s, r.gap_class) for r in I.classify_gaps(gdf, df, **cut).collect()) == want


def test_ranges_follow_the_data(spark):
    rng = random.Random(6)
    busy = [("k", 1e6 + rng.random()) for _ in range(2000)] + [("k", float(86400 * i)) for i in range(50)] + [(None, 5.0)] * 300
    df = S.with_ranges(spark.createDataFrame(busy, "k string, at double"), ["k"], "at", F.lit(True), rows=100).collect()
    own = sorted((r.at, r._block) for r in df if r.k == "k")
    assert [b for _, b in own] == sorted(b for _, b in own)
    sizes = [sum(b == n for _, b in own) for n in {b for _, b in own}]
    assert len(sizes) >= 15 and max(sizes) <= 300
    assert len({r._block for r in df if r.k is None}) == 1  # one value cannot be cut
    names = spark.createDataFrame([(f"/home/someone/projects/p{i:04d}",) for i in range(3000)], "p string")
    cut = S.with_name_ranges(names, "p", 63, "c").orderBy("p").collect()
    assert [r.c for r in cut] == sorted(r.c for r in cut) and len({r.c for r in cut}) == 64
    assert max(sum(r.c == n for r in cut) for n in range(64)) < 400


def test_names_inside_paths(spark):
    labels = spark.createDataFrame([("/srv/a", "project-01"), ("/srv/a/b", "project-02"), ("x-y", "project-03")], "project string, label string")
    rows = [(1, "in /srv/a/b/c.py, /srv/a/z and /srv/ab; x-y x-yz /srv/a/b"), (2, None), (3, "")]
    got = publish.scrub_mentions(spark.createDataFrame(rows, "id int, t string"), labels, "id", "t").orderBy("id").collect()
    assert [r.t for r in got] == ["in project-02/c.py, project-01/z and /srv/ab; project-03 x-yz project-02", None, ""]


def test_outcome_rules(spark):
    cases = {
        "Thanks a lot!": ("satisfaction", "thanks"), "lgtm": ("satisfaction", "lgtm"),
        "that is wrong": ("dissatisfaction", "wrong"), "can you fix it": ("unclear", ""),
        "will this fix the old bug in there?": ("new_task", "new request"),
        "fix the old bug in there now ok": ("dissatisfaction", "fix (potential)"),
        "also add a test": ("continuation", "also"), "hello": ("unclear", ""),
        "[Request interrupted by user]": ("system_continuation", "auto-generated"),
        "  implement the following plan: x": ("system_continuation", "auto-generated"),
        "l'éfix est une partie de la phrase": ("new_task", "new request"),
        "no, that was it": ("dissatisfaction", "no, that/this"),
    }
    got = values(spark, cases, O.task_outcome(F.col("t")))
    assert [tuple(g) for g in got] == list(cases.values())
    assert values(spark, ["got it", "actually no", "next thing", None], O.completion_signal(F.col("t"))) == [
        "explicit_done", "user_dissatisfied", "user_continues", "session_end"]


def test_message_predicates(spark):
    assert values(spark, ["<local-command x", " <task-notification> ", "  \n ", "hello", "<summary>"], T.is_skipped(F.col("t"))) == [
        True, True, True, False, False]
    assert values(spark, ["<summary> x", "Analysis: y", "This analysis: y"], T.is_generated(F.col("t"))) == [True, True, False]
    assert values(spark, ["", "a", "a\nb", None], T.line_count(F.col("t"))) == [0, 1, 2, 0]


def test_substring_filter_never_loses_a_match(spark):
    from taskloom.functions import patterns as P
    pats = [p for group in P.TASK_TYPES.values() for p in group] + [p for v in (P.QUALITY_VOTES, P.WORK_VOTES, P.SENTIMENT_VOTES)
            for group in v.values() for p in group] + P.POSITIVE_WORDS + P.NEGATIVE_WORDS
    texts = ["thank you", "don't do it", "from here to there", "run 3 instances", "let's try", "ok.", "continue...", "clean up",
             "cleanup now", "well-executed", "follow the instructions", "doesn't seem to be", "no, wait", "implemented as requested",
             "analysis", "use this instead of that", "this session is being continued", "addressed the bug"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = df.select([F.count_if(T.matches_low(F.col("t"), p, True) != T.matches(F.col("t"), f"(?i:{p})")).alias(f"c{i}")
                     for i, p in enumerate(pats)]).first()
    assert sum(bad) == 0


def test_classifiers(spark):
    assert values(spark, ["Fix the bug and add docs", "xyz", "ok", "refactor and rename"], C.task_types(F.col("t"))[0]) == [
        "bugfix", "unknown", "continuation", "refactor"]
    assert values(spark, ["run in parallel", "use an agent to search", "delegate it", "nothing"], C.agent_directive(F.col("t"))) == [
        "parallel", "use_agents", "use_agents", None]
    assert values(spark, ["Exit code 1", "all fine", "Traceback", ""], C.looks_like_error(F.col("t"))) == [True, False, True, False]
    df = spark.createDataFrame([(["a.py", "b.py", "c.md"],), (["a.ts", "b.py"],), ([],), (["zzz"],)], "f array<string>")
    assert [r[0] for r in df.select(C.domain_of_files(F.col("f"))).collect()] == ["backend", "mixed", "unknown", "unknown"]
    levels = spark.createDataFrame([(3, 1, 20), (4, 1, 20), (11, 1, 1), (31, 1, 1), (81, 1, 1), (1, 26, 1)], "t int, f int, l int")
    assert [r[0] for r in levels.select(C.complexity(F.col("t"), F.col("f"), F.col("l"))).collect()] == [
        "trivial", "simple", "moderate", "complex", "major", "major"]


def test_annotation_normalisation(spark):
    assert values(spark, ["Complete", "partial - x", "failed hard", "not_started", "in_progress", None], G.completion(F.col("t"))) == [
        "complete", "partial", "failed", "interrupted", "partial", "partial"]
    assert values(spark, ["4", "x", None], G.valid_score(F.col("t"))) == [4, 3, 3]
    assert values(spark, ["Feature ", "other"], G.valid_type(F.col("t"))) == ["feature", ""]
    assert values(spark, ['say {"a": 1} ok', "none"], G.salvaged_json(F.col("t"))) == ['{"a": 1}', None]
    assert values(spark, ["dissatisfied", "Satisfied", "unclear", "iterative", "?"], G.sentiment_bucket(F.col("t"))) == [
        "dissatisfied", "satisfied", "neutral", "collaborative", "other"]


def test_anonymise_and_scrub(spark):
    rows = [(1, "-home-x-alpha", "/home/x/alpha/a.py", "see /home/x/alpha and -home-x-alpha"),
            (2, "-home-x-beta", "rel.py", "mentions -home-x-alpha too"), (3, "", "", "none")]
    df = spark.createDataFrame(rows, "id int, project_path string, file_path string, body string")
    labels = publish.project_labels([df, df])
    got = publish.scrub_mentions(publish.anonymise(df, labels, ["body"], "/home/x"), labels, "id", "body").orderBy("id").collect()
    assert [tuple(r[c] for c in ("project_path", "file_path", "body")) for r in got] == [
        ("project-01", "[redacted]", "see /home/user/alpha and project-01"),
        ("project-02", "rel.py", "mentions project-01 too"), ("", "", "none")]
    assert publish.leaks(spark.createDataFrame(got), ["body"], ["/home/x", "-home-x-"]).count() == 0


def test_sources(spark, tmp_path):
    schema = "task_id string, n int"
    assert TB.read_json_table(spark, str(tmp_path / "absent.json"), schema).count() == 0
    (tmp_path / "t.json").write_text(json.dumps([{"task_id": "x", "n": 1}, {"task_id": "y", "n": 2}]))
    assert TB.read_json_table(spark, str(tmp_path / "t.json"), schema).count() == 2
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "s-task-1_ab12.json").write_text(json.dumps({"alignment_score": 4, "task_type": "docs"}))
    row = TB.read_annotations(spark, str(notes)).first()
    assert (row.task_id, row.alignment_score, row.task_type) == ("s-task-1", "4", "docs")
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "a.json").write_text(json.dumps({"run_id": "r1", "task": "t", "verification": {"overall_success": True}}))
    (runs / "b.json").write_text("{broken")
    assert [r.run_id for r in TB.read_runs(spark, str(runs)).collect()] == ["r1"]
    tasks = spark.createDataFrame([("a", "t1", ""), ("b", "t2", ""), ("a", "t3", "slash_command")],
                                  "cohort string, task_id string, exclude_reason string")
    TB.write_by_cohort(tasks, str(tmp_path / "tasks"))
    assert TB.cohorts_of(spark, str(tmp_path / "tasks")) == ["a", "b"]
    assert TB.read_tasks(spark, str(tmp_path / "tasks")).count() == 2
    assert TB.read_tasks(spark, str(tmp_path / "tasks"), ["a"], True).count() == 2
    assert TB.first_available(spark, [str(tmp_path / "no"), str(tmp_path / "tasks")]).count() == 3
    filled = TB.fill_identity(spark.createDataFrame([("t1", None)], "task_id string, project_path string"),
                              spark.createDataFrame([("t1", "p", "s")], "task_id string, project_path string, session_id string"))
    assert tuple(filled.first()) == ("t1", "p", "s")


def test_lookup(spark):
    df = spark.sql("select named_struct('x', array(named_struct('k', 'a', 'v', 1), named_struct('k', 'b', 'v', 2))) as d")
    got = df.select(TB.lookup(F.col("d"), "x[k={c}].v", {"c": "b"}), TB.lookup(F.col("d"), "x[0].v"), TB.lookup(F.col("d"), "x[9].v")).first()
    assert tuple(got) == (2, 1, None)


def test_config(spark):
    cfg = Measurements.from_dict({"measurements": {"categorical": ["c"], "proportions": {"p": {"field": "c", "value": "x"}}},
                                  "cross_cuts": [{"name": "all"}, {"name": "k", "field": "k", "values": ["1"], "min_n": 5}],
                                  "themes": {"t": ["c"]}})
    assert cfg.categorical == ("c",) and cfg.proportions == {"p": ("c", "x")} and cfg.cross_cuts[1].min_n == 5
    assert pair_from_name("fam-1.5-vs-2.0")["cohort_b"] == "fam-2-0"
    assert cohort_pair(spark.createDataFrame([("b",), ("a",)], "cohort string")) == ("a", "b")
    with pytest.raises(ValueError):
        cohort_pair(spark.createDataFrame([("b",)], "cohort string"))


def test_browse(spark):
    rows = [("t1", "add a parser", ["Read", "Edit"], 2), ("t2", "add a lexer", ["Read"], 2), ("t3", "something else", ["Bash"], 9)]
    df = spark.createDataFrame(rows, "task_id string, user_prompt string, tools array<string>, files int")
    got = browse.similar_to(df, df.where("task_id = 't1'"), 2).collect()
    assert [r.task_id for r in got] == ["t2", "t3"]
    assert got[0].score == pytest.approx(0.5 * 2 / 4 + 0.3 * 1 / 2 + 0.2)


def test_top_and_ngrams(spark):
    calls = spark.createDataFrame([("s", i, n) for i, n in enumerate("ABABC")], "s string, i long, name string")
    for size in (1, 2, 100):
        grams = {r.gram: r["count"] for r in TM.tool_ngrams(calls, ["s"], ["i"], S.index_chunk("i", size), ["s"]).collect()}
        assert grams == {"A->B": 2, "B->A": 1, "B->C": 1, "A->B->A": 1, "B->A->B": 1, "A->B->C": 1}


def test_incremental_ingestion(spark, tmp_path):
    from taskloom import streaming
    from tests import sessions as X

    src, out, cp = tmp_path / "src", tmp_path / "out", tmp_path / "cp"
    X.write_session(src, "p", "one", X.NOISE)
    X.write_session(src, "p", "agent-1", X.NOISE)
    streaming.ingest(spark, f"{src}/*", str(out), str(cp)).awaitTermination()
    first = spark.read.parquet(str(out)).count()
    X.write_session(src, "p", "two", X.CLEAN)
    streaming.ingest(spark, f"{src}/*", str(out), str(cp)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == first + len(X.CLEAN)


def test_null_keys_and_chunks_keep_their_rows(spark):
    from pyspark.sql import functions as F

    from taskloom.operators import ranks, scan

    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", None, 30.0), (None, 5, 1.0), (None, None, 2.0)], "k string, t int, v double")
    out = scan.ordered(df, ["k"], ["t"], F.col("t") % 2, total=scan.overall(F.col("v"))).collect()
    assert sorted((r.k or "", r.total) for r in out) == [("", 3.0), ("", 3.0), ("a", 60.0), ("a", 60.0), ("a", 60.0)]
    got = ranks.ranked(df, ["k"], "v").collect()
    assert sorted((r.k or "", r.v, r.below, r["size"]) for r in got) == [
        ("", 1.0, 0, 2), ("", 2.0, 1, 2), ("a", 10.0, 0, 3), ("a", 20.0, 1, 3), ("a", 30.0, 2, 3)]


def test_one_first_request_per_task(spark):
    d = spark.createDataFrame([("t", 1.0, "b"), ("t", 1.0, "a"), ("t", 2.0, "c"), ("u", None, "x"), ("u", 3.0, "y"), ("w", None, "z")],
                              "task string, at double, id string")
    got = TM.first_requests(d, ["task"], ["at", "id"])
    assert sorted((r.task, r.id) for r in got.where("is_first").collect()) == [("t", "a"), ("u", "y")]
    assert got.where("not is_first").count() == 4


def test_ranges_are_searched_without_functions_of_array_elements(spark, capsys):
    df = spark.range(3000).selectExpr("id % 3 as k", "cast(if(id % 3 = 0, id div 7, id * id) as double) as v")
    cut = S.with_ranges(df, ["k"], "v", F.lit(True), rows=50)
    cut.explain(True)
    assert "lambda" not in capsys.readouterr().out
    spans = cut.groupBy("k", "_block").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "_block").collect()
    assert len(spans) > 30
    assert all(a.k != b.k or a.hi < b.lo for a, b in zip(spans, spans[1:]))
