"""The whole analysis and every report view on hand-written sessions."""

import pytest

from taskloom.plans import pipeline, views
from tests import sessions as X


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("all")
    for i in range(4):
        model = "model-a" if i % 2 == 0 else "model-b"
        def own(messages):
            out = []
            for m in messages:
                if isinstance(m, dict) and m["type"] == "assistant":
                    m = {**m, "message": {**m["message"], "model": model}}
                out.append(m)
            return out
        for name, messages in {"basic": X.BASIC, "compact": X.COMPACT, "plan": X.PLAN, "edits": X.EDITS}.items():
            X.write_session(folder, f"project{i // 2}", f"{name}{i}", own(messages))
    notes = spark.createDataFrame(
        [("basic0-task-1", "complete", "5", "good work", "very satisfied"),
         ("basic1-task-1", "partial - half", "2", "poor", "frustrated")],
        "task_id string, task_completion string, alignment_score string, execution_quality string, user_sentiment string")
    return pipeline.analyse(spark, str(folder), {"model-a": "a", "model-b": "b"}, notes)


def test_cohorts_and_annotations(results):
    rows = {r.task_id: r for r in results.annotated.collect()}
    assert rows["basic0-task-1"].cohort == "a" and rows["basic1-task-1"].cohort == "b"
    assert rows["basic0-task-1"].normalized_user_sentiment == "satisfied"
    assert rows["basic0-task-1"].normalized_execution_quality == "good"
    assert rows["basic1-task-1"].task_completion == "partial"
    assert rows["basic1-task-1"].normalized_user_sentiment == "dissatisfied"
    assert rows["basic0-task-2"].alignment_score == 3


def test_sessions(results):
    row = results.sessions.where("session_id = 'basic0'").first()
    assert row.tools_used == {"Read": 2, "Edit": 1, "Bash": 1}
    assert row.model_counts == {"model-a": 5} and row.duration_minutes == 9.0


def test_tests_and_findings(results):
    tests = results.tests.where("slice = 'overall'").collect()
    assert {"chi-square", "mann-whitney-u", "two-proportion-z"} <= {t.test for t in tests}
    assert all(0 <= t.p_value <= 1 and t.p_adjusted >= t.p_value - 1e-12 for t in tests)
    ranks = [r["rank"] for r in results.findings.select("rank").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


@pytest.mark.parametrize("name", sorted(views.VIEWS))
def test_every_view_runs(results, name):
    views.VIEWS[name](results).collect()


def test_view_numbers(results):
    mix = {(r.kind, r.value): (r.count_a, r.count_b) for r in views.VIEWS["v_dataset_task_mix"](results).collect()}
    assert all(a == b for a, b in mix.values())
    over = {r.cohort: r for r in views.VIEWS["v_compaction_overview"](results).collect()}
    assert over["a"].total_events == 4 and over["a"].sessions_with_events == 2
    comp = {r.cohort: r for r in views.VIEWS["v_dataset_composition"](results).collect()}
    assert comp["a"].sessions == 8 and comp[None].sessions == 16 and comp["a"].shared_projects == 2


def test_views_of_tests_and_types(results):
    wide = views.VIEWS["v_verbosity_by_type"](results).collect()
    assert all(r.type != "unknown" and r.avg_output_tokens_a > 0 and r.avg_output_tokens_b > 0 for r in wide)
    tests = views.VIEWS["v_satisfaction_tests"](results).collect()
    assert tests and all(r.n_a > 0 and r.n_b > 0 for r in tests)
    assert all(r.median_a is not None and r.std_b is not None for r in tests if r.test == "mann-whitney-u")
    themed = views.VIEWS["v_findings_by_theme"](results).collect()
    assert len(themed) == results.findings.count()
    one = next((r.theme for r in themed if r.theme), None)
    if one:
        assert {r.theme for r in views.findings_by_theme(results, one).collect()} == {one}
