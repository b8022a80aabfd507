"""Hand-written sessions through the log source and the task tables."""

import pytest

from taskloom.operators import segment, tasks
from taskloom.sources import logs
from taskloom.sources.stage import stage
from tests import sessions as X


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for name, messages in {"basic": X.BASIC, "noise": X.NOISE, "compact": X.COMPACT,
                           "plan": X.PLAN, "clean": X.CLEAN, "agent-x": X.BASIC}.items():
        X.write_session(folder, "proj one", name, messages)
    X.write_session(folder, "skipme", "other", X.BASIC)
    messages = stage(logs.read_messages(spark, str(folder), exclude_projects=["skipme"]))
    return messages, tasks.canonical(messages)


def rows(df, *cols, session=None):
    df = df.where(f"session_id = '{session}'") if session else df
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_message_index_skips_broken_lines(tables):
    messages, _ = tables
    assert rows(messages, "msg_index", "type", "is_tool_result", "user_text", session="noise") == [
        (0, "user", False, "<system-reminder> nothing"), (1, "user", True, ""),
        (2, "user", False, "first second"), (3, "assistant", False, "hi"), (4, "user", False, "   "),
    ]
    assert {r.session_id for r in messages.select("session_id").distinct().collect()} == {
        "basic", "noise", "compact", "plan", "clean"}
    assert rows(messages.select("project_path").distinct(), "project_path") == [("proj one",)]


def test_basic_tasks(tables):
    _, t = tables
    got = {r.task_id: r for r in t.tasks.where("session_id = 'basic'").collect()}
    assert sorted(got) == ["basic-task-1", "basic-task-2", "basic-task-3"]
    one, two, three = got["basic-task-1"], got["basic-task-2"], got["basic-task-3"]
    assert (one.msg_index_start, one.msg_index_end) == (0, 6)
    assert (three.msg_index_start, three.msg_index_end) == (11, 12)
    assert (one.outcome_category, one.outcome_evidence) == ("satisfaction", "thanks")
    assert (two.outcome_category, two.outcome_evidence) == ("dissatisfaction", "wrong")
    assert three.outcome_category == "session_end"
    assert (one.tool_count, one.tool_sequence, one.total_files_touched) == (3, "Read→Edit", 2)
    assert (one.total_lines_added, one.total_lines_removed) == (3, 2)
    # first message of the request counts for input and cache, maximum for output
    assert (one.input_tokens, one.output_tokens, one.cache_read_tokens, one.cache_write_tokens) == (10, 9, 100, 7)
    assert (one.request_count, one.parallel_tool_messages, one.messages_with_tools) == (1, 1, 2)
    assert one.duration_seconds == 180.0
    assert one.estimated_cost == pytest.approx(round((10 * 15 + 9 * 75 + 100 * 1.875 + 7 * 18.75) / 1e6, 4))
    assert (one.thinking_chars, one.text_chars) == (6, 11)
    assert (two.turn_duration_ms, two.run_in_background_count, two.error_count) == (1500, 1, 1)
    assert two.classification.type == "investigation"
    assert one.classification.complexity == "trivial" or one.classification.complexity == "simple"
    assert one.task_summary == "Please add a new parser module to the project... (3 tools, 2 files)"


def test_edit_event_needs_a_result(tables):
    _, t = tables
    assert rows(t.edits, "task_n", "tool_name", "file_path", "succeeded", session="basic") == [
        (1, "Edit", "/p/a.py", True)]


def test_compaction_goes_to_open_or_first_task(tables):
    _, t = tables
    assert rows(t.compactions, "task_n", "trigger", "pre_tokens", session="compact") == [
        (1, "auto", 1000), (1, "manual", 500)]
    assert "post_compaction" in t.tasks.where("task_id = 'compact-task-1'").first().flags


def test_plan_merge(tables):
    _, t = tables
    got = rows(t.tasks, "task_id", "exclude_reason", "used_planning", "output_tokens", "total_files_touched",
               session="plan")
    # the message after a planning task is generated text, so that task is itself excluded and
    # the first plan is promoted; the next plan of the same island joins it
    assert got == [
        ("plan-task-1", "system_continuation", True, 3, 0),
        ("plan-task-3", "", True, 4, 1),
        ("plan-task-4", "system_continuation", False, 1, 0),
        ("plan-task-6", "", True, 4, 1),
        ("plan-task-8", "system_continuation", False, 0, 0),
    ]
    assert {r.task_n for r in t.calls.where("session_id = 'plan'").collect()} == {1, 3, 6}


def test_plan_joins_a_kept_planning_task(spark):
    rows_in = [
        ("s", 1, 0, "design it", True, ""), ("s", 2, 5, "[Request interrupted", False, "x"),
        ("s", 3, 7, "Implement the following plan: a", False, "x"),
        ("s", 4, 9, "Implement the following plan: b", False, "x"),
        ("s", 5, 11, "[Request interrupted", False, "x"),
        ("s", 6, 12, "other work", False, ""), ("s", 7, 14, "[Request interrupted", False, "x"),
        ("s", 8, 15, "Implement the following plan: c", False, "x"),
    ]
    table = spark.createDataFrame(
        rows_in, "session_id string, task_n long, msg_index_start long, user_prompt string, "
                 "used_planning boolean, exclude_reason string")
    for size in (1, 3, 100):
        got = {r.task_n: (r.root_n, r.promoted) for r in tasks.plan_roots(table, size).collect()}
        assert got == {1: (1, False), 2: (1, False), 3: (1, False), 4: (1, False), 5: (5, False),
                       6: (6, False), 7: (8, False), 8: (8, True)}


def test_cleaning(tables):
    _, t = tables
    assert rows(t.tasks, "task_id", "exclude_reason", session="clean") == [
        ("clean-task-1", "slash_command"), ("clean-task-2", "empty_continuation"),
        ("clean-task-3", "no_response_interrupt")]


def test_chunk_size_does_not_matter(tables):
    messages, _ = tables
    def n(size):
        marked = segment.mark_tasks(messages, chunk_size=size)
        return rows(segment.task_starts(marked, size), "task_id", "msg_index_end", "next_text")
    assert n(1) == n(2) == n(4096)


def test_nested_row(tables):
    _, t = tables
    row = tasks.nested(t).where("task_id = 'basic-task-1'").first()
    assert [c["name"] for c in row.tool_calls] == ["Read", "Read", "Edit"]
    assert row.request_timings[0]["tool_count"] == 3


def test_texts_stay_whole(spark, tmp_path):
    head = "x = 1  # the same beginning\n" * 40
    prompt = "please " * 200 + "[Request interrupted by user]"
    X.write_session(tmp_path, "p", "long", [
        X.user(prompt, 0),
        X.agent(1, X.tool("a", "Edit", file_path="f", old_string=head + "first", new_string=head + "second"),
                X.tool("b", "Bash", command="echo " * 100 + "end")),
        X.result("a", 2), X.result("b", 3, "error: " + "y" * 400 + "tail", True),
        X.user("thanks, " + "very well " * 100 + "done", 4),
    ])
    t = tasks.canonical(stage(logs.read_messages(spark, str(tmp_path))))
    first = t.tasks.where("task_n = 1").first()
    assert first.user_prompt == prompt and "interrupted" in first.flags
    assert first.next_user_message.endswith("done")
    edit = t.edits.first()
    assert (edit.old_string, edit.new_string) == (head + "first", head + "second")
    assert t.errors.first()["text"].endswith("tail")
