"""Builders of small hand-written session logs."""

import json


def at(minute: float) -> str:
    """Time stamp ``minute`` minutes after noon."""
    seconds = int(round(minute * 60))
    return f"2025-01-01T{12 + seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}Z"


def user(text, minute, **extra):
    return {"type": "user", "timestamp": at(minute), "message": {"content": text}, **extra}


def result(tool_id, minute, text="ok", error=False):
    block = {"type": "tool_result", "tool_use_id": tool_id, "content": text}
    if error:
        block["is_error"] = True
    return {"type": "user", "timestamp": at(minute), "message": {"content": [block]}}


def text(value):
    return {"type": "text", "text": value}


def thinking(value):
    return {"type": "thinking", "thinking": value}


def tool(tool_id, name, **inputs):
    return {"type": "tool_use", "id": tool_id, "name": name, "input": inputs}


def agent(minute, *blocks, request=None, model="model-a", **usage):
    message = {"type": "assistant", "timestamp": at(minute),
               "message": {"model": model, "content": list(blocks), "usage": usage}}
    if request:
        message["requestId"] = request
    return message


def system(subtype, minute, **extra):
    return {"type": "system", "subtype": subtype, "timestamp": at(minute), **extra}


def write_session(folder, project, session_id, messages):
    """Strings are written as they are, dicts as JSON."""
    place = folder / project
    place.mkdir(parents=True, exist_ok=True)
    lines = [m if isinstance(m, str) else json.dumps(m) for m in messages]
    (place / f"{session_id}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")


LINE_A = "def alpha_function(first, second):"
LINE_B = "    return first + second + 1000000"
LINE_C = "    value = compute_everything_again()"

BASIC = [
    user("Please add a new parser module to the project", 0),
    agent(1, thinking("hmm ok"), text("Reading"), tool("t1", "Read", file_path="/p/a.py"),
          request="r1", input_tokens=10, output_tokens=5, cache_read_input_tokens=100,
          cache_creation_input_tokens=7),
    result("t1", 1.5),
    agent(2, tool("t2", "Read", file_path="/p/b.py"), tool("t3", "Edit", file_path="/p/a.py",
          old_string="x\ny", new_string="x\ny\nz"), request="r1", input_tokens=999, output_tokens=9),
    result("t2", 2.2), result("t3", 2.3),
    agent(3, text("done"), request="r1", output_tokens=7),
    user("Thanks, that is perfect. Now explain the tests in detail", 5),
    agent(6, tool("t4", "Bash", command="pytest -q", run_in_background=True), request="r2",
          input_tokens=1, output_tokens=2),
    result("t4", 6.5, "Traceback (most recent call last)", True),
    system("turn_duration", 6.6, durationMs=1500),
    user("that is wrong, revert the last change please", 8),
    agent(9, text("ok"), request="r3", output_tokens=4),
]
NOISE = [
    "", "{broken json", user("<system-reminder> nothing", 0), result("zz", 0.5),
    user([{"type": "text", "text": "first"}, "second"], 1), "   ",
    agent(2, text("hi"), request="q1", output_tokens=1),
    user("   ", 3),
]
COMPACT = [
    system("compact_boundary", 0, compactMetadata={"trigger": "auto", "preTokens": 1000}),
    user("start the work on the new module", 1),
    agent(2, text("a"), request="c1", output_tokens=1),
    system("compact_boundary", 3, compactMetadata={"trigger": "manual", "preTokens": 500}),
    user("and now the second part of the work", 4),
    agent(5, text("b"), request="c2", output_tokens=1),
]
PLAN = [
    user("design the storage layer for me", 0),
    agent(1, tool("p1", "EnterPlanMode"), request="a1", output_tokens=3),
    user("[Request interrupted by user for tool use]", 2),
    user("Implement the following plan: step one", 3),
    agent(5, tool("p2", "Write", file_path="/p/s.py", content="a\nb"), request="a2", output_tokens=4),
    result("p2", 5.5),
    user("an unrelated question about the weather", 6),
    agent(7, text("sunny"), request="a3", output_tokens=1),
    user("[Request interrupted by user]", 8),
    user("Implement the following plan: step two", 9),
    agent(10, tool("p3", "Write", file_path="/p/t.py", content="c"), request="a4", output_tokens=2),
    user("Implement the following plan: step three", 11),
    agent(12, tool("p4", "Write", file_path="/p/t.py", content="d"), request="a5", output_tokens=2),
    user("[Request interrupted by user]", 13),
]
CLEAN = [
    user("/compact", 0), agent(0.1, text("ok"), request="k1"),
    user("ok.", 1), agent(1.05, text("fine"), request="k2"),
    user("tell me about the last thing", 2),
]

OLD = "def compute(a, b):\n    return a + b + 12345"
NEW = "def compute(a, b):\n    total = a + b + 12345\n    return total * 2"
NEWER = "def compute(a, b):\n    total = a - b - 54321\n    return total * 3"
EDITS = [
    user("please rewrite the compute function in the module", 0),
    agent(1, tool("e1", "Edit", file_path="/p/m.py", old_string=OLD, new_string=NEW), request="b1", output_tokens=1),
    result("e1", 1.1),
    # exact re-edit in the same task: self-correction, kills the text of e1
    agent(2, tool("e2", "Edit", file_path="/p/m.py", old_string=NEW, new_string=NEWER), request="b2", output_tokens=1),
    result("e2", 2.1),
    agent(3, tool("e3", "Bash", command="pytest"), request="b3", output_tokens=1),
    result("e3", 3.1, "Traceback: it failed", True),
    # after an error: error recovery
    agent(4, tool("e4", "Edit", file_path="/p/m.py", old_string=NEWER, new_string=NEW), request="b4", output_tokens=1),
    result("e4", 4.1),
    # failed edit is counted, but is no lineage
    agent(4.5, tool("e5", "Edit", file_path="/p/m.py", old_string=NEW, new_string="x" * 30), request="b5", output_tokens=1),
    result("e5", 4.6, "no match", True),
    user("that is wrong, undo it please", 6),
    # another task after an unhappy message: user directed, old text contained in the live text
    agent(7, tool("e6", "Edit", file_path="/p/m.py", old_string=NEW[19:], new_string="y" * 25), request="b6", output_tokens=1),
    result("e6", 7.1),
    # replace_all neither matches nor overwrites
    agent(8, tool("e7", "Edit", file_path="/p/m.py", old_string=NEW, new_string="z" * 25, replace_all=True), request="b7", output_tokens=1),
    result("e7", 8.1),
]
