"""Edit lineage against a sequential replay, and against hand-written cases."""

import os
import random
from collections import Counter

import pytest

from taskloom.operators import edits as E
from taskloom.operators import scan as S
from taskloom.sources.stage import stage

EDIT_SCHEMA = ("session_id string, file_path string, task_id string, msg_index long, pos int, tool_name string, "
               "old_string string, new_string string, replace_all boolean")


def lines_of(text):
    return {x.strip() for x in text.split("\n") if len(x.strip()) > 15}


def tier_of(new, old):
    if new == old:
        return "exact", 1.0
    for small, big in ((new, old), (old, new)):
        if len(small) >= 40 and small in big and len(small) / len(big) >= 0.3:
            return "containment", len(small) / len(big)
    a, b = lines_of(new), lines_of(old)
    both = len(a & b)
    if both and (both / len(a | b) > 0.3 or both / len(b) > 0.5):
        return "line_overlap", max(both / len(a | b), both / len(b))
    return None, 0.0


def replay(rows):
    """One edit after the other with the live pieces of every file kept in a list."""
    live, found = {}, Counter()
    for session, file, _task, index, pos, name, old, new, every in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        pieces = live.setdefault((session, file), [])
        if not every and max(len(old), len(new)) >= 20:
            if name == "Write":
                pieces.clear()
            elif len(old) >= 20:
                for text, at in pieces:
                    tier, ratio = tier_of(text, old)
                    if tier and at < index:
                        found[session, file, at, index, tier, round(ratio, 9)] += 1
                pieces[:] = [p for p in pieces if p[0] not in old]
        if len(new) >= 20:
            pieces.append((new, index))
    return found


def lineage(spark, rows, keep):
    df = E.overlaps(E.prepare(spark.createDataFrame(rows, EDIT_SCHEMA)), keep)
    return Counter((r.session_id, r.file_path, r.edit_a_index, r.edit_b_index, r.tier, round(r.ratio, 9)) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_lineage_equals_replay(spark, seed):
    rng = random.Random(seed)
    words = [f"statement_number_{i} = compute({i})" for i in range(6)] + ["x = 1", "}", "    return result_of_it"]
    def snippet():
        return "\n".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    rows, texts = [], [snippet() for _ in range(8)]
    for i in range(70):
        session = "hot" if rng.random() < 0.8 else f"s{rng.randint(0, 2)}"
        old = rng.choice(texts)
        if rng.random() < 0.3 and len(old) > 30:
            old = old[rng.randint(0, 6):len(old) - rng.randint(0, 6)]
        new = rng.choice(texts) if rng.random() < 0.7 else snippet() + old
        name = "Write" if rng.random() < 0.08 else "Edit"
        rows.append((session, rng.choice("fg"), f"t{i // 9}", i // 2, i % 2, name, "" if name == "Write" else old, new,
                     rng.random() < 0.1))
    want = replay(rows)
    assert len(want) > 5
    assert lineage(spark, rows, stage) == want


def test_edit_signals_equal_brute_force(spark):
    rng = random.Random(9)
    pool = ["}", "ab", "abc", "abcd", "some short text", "some short text that is longer than twenty",
            "x" * 70 + "tail", "x" * 70, "nothing alike here", ""]
    rows = [("s", f"f{rng.randint(0, 1)}", i // 12, i, 0, rng.choice(pool), rng.choice(pool)) for i in range(48)]
    events = spark.createDataFrame(
        rows, "session_id string, file_path string, task_n int, msg_index long, pos int, old_string string, new_string string")
    errors = spark.createDataFrame([("s", 0, 2), ("s", 1, 12), ("s", 2, 20)], "session_id string, task_n int, msg_index long")
    tasks = events.select("session_id", "task_n").distinct().selectExpr("*", "'no, that is wrong' as next_user_message")
    got = {r.task_n: (r.self_corrections, r.error_recoveries, r.max_chain_depth, r.user_corrections)
           for r in E.edit_signals(events, errors, tasks).collect()}
    for n in range(4):
        mine = [r for r in rows if r[2] == n]
        corrected = sum(1 for i, r in enumerate(mine) if r[5] and any(
            p[1] == r[1] and p[6] and (p[6] in r[5] or r[5] in p[6]) for p in mine[:i]))
        bad = {0: 2, 1: 12, 2: 20}.get(n, -99)
        recovered = sum(1 for r in mine if 0 < r[3] - bad <= 10)
        deepest = max(sum(1 for r in mine if r[1] == f) for f in {r[1] for r in mine})
        assert got[n] == (corrected, recovered, deepest, 1)


def test_classes_and_depth(spark, tmp_path_factory):
    from taskloom.operators import tasks as TK
    from taskloom.sources import logs
    from tests import sessions as X

    folder = tmp_path_factory.mktemp("edits")
    X.write_session(folder, "p", "edits", X.EDITS)
    t = TK.canonical(logs.read_messages(spark, str(folder)))
    named = t.tasks.select("session_id", "task_n", "task_id")
    events = t.edits.join(named, ["session_id", "task_n"])
    edits = stage(E.prepare(events.where("succeeded")))
    found = stage(E.overlaps(edits, stage))
    depths = E.chain_depths(found)
    done = E.classify_overlaps(found, E.edit_context(t.tasks, t.errors), depths)
    got = [(r.edit_a_index, r.edit_b_index, r.tier, r.classification, r.depth) for r in done.orderBy("edit_b_index").collect()]
    assert [g[2:] for g in got] == [("exact", "self_correction", 1), ("exact", "error_recovery", 2),
                                    ("containment", "user_directed", 3)]
    m = {r.task_id: r for r in E.edit_metrics(edits, done, events).collect()}
    one, two = m["edits-task-1"], m["edits-task-2"]
    assert (one.edit_count, one.overlap_count, one.failed_edit_count, one.max_chain_depth) == (3, 2, 1, 2)
    assert one.triage_score == pytest.approx((3 + 2 + 2) / 3)
    assert (two.edit_count, two.replace_all_count, two.user_corrections) == (2, 1, 1)


def test_anchor_guarantee():
    rng = random.Random(1)
    for least, gram, window in E.LEVELS:
        for _ in range(50):
            size = rng.randint(least, least + 40)
            small = "".join(rng.choice("abé ") for _ in range(size))
            big = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + small + "tail" * rng.randint(0, 5)
            assert min(E._anchors(small, gram, window)) in set(E._anchors(big, gram, window))


def test_anchors_tell_texts_apart():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    other = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    for _least, gram, window in E.LONG_LEVELS:
        mine = set(E._anchors(text, gram, window))
        assert len(mine) >= (1500 - gram) / window - 1
        assert not mine & set(E._anchors(other, gram, window))


def depths_of(spark, edges, keep=stage):
    df = spark.createDataFrame(edges, "session_id string, edit_a_index long, edit_b_index long")
    return {(r.session_id, r.edit_index): r.depth for r in E.chain_depths(df, keep).collect()}


def test_depth_of_random_graphs(spark):
    rng = random.Random(11)
    edges = []
    for s in range(6):
        n = 40
        for _ in range(rng.randint(20, 120)):
            a, b = sorted(rng.sample(range(n), 2))
            edges.append((f"s{s}", a, b if rng.random() < 0.5 else min(n - 1, a + rng.randint(1, 3))))
    edges = [e for e in edges if e[1] < e[2]]
    want = {}
    for s, a, b in sorted(edges, key=lambda e: (e[0], e[2])):
        want[s, b] = max(want.get((s, b), 0), want.get((s, a), 0) + 1)
    # an edge may be met before its start is final: repeat until nothing changes
    changed = True
    while changed:
        changed = False
        for s, a, b in edges:
            deeper = want.get((s, a), 0) + 1
            if deeper > want[s, b]:
                want[s, b], changed = deeper, True
    assert depths_of(spark, edges + edges[:9]) == want


def test_depth_of_a_long_chain(spark):
    n, written = 10_000, []

    def counted(df, name="stage"):
        written.append(name)
        return stage(df, name)

    edges = [("s", i, i + 1) for i in range(n)] + [("s", i, i + 2) for i in range(0, n - 2, 5)] + [("t", 1, 2)]
    got = depths_of(spark, edges, counted)
    assert got["s", n] == n and got["s", 4321] == 4321 and got["t", 2] == 1
    assert len(written) < 40  # rounds grow with the logarithm of the length


def test_no_overlap_no_depth(spark):
    assert E.chain_depths(spark.createDataFrame([], "session_id string, edit_a_index long, edit_b_index long")).collect() == []


def test_common_lines_bring_no_texts_together(spark):
    licence = [f"this licence line number {i} is in every file" for i in range(12)]
    texts = []
    for k in range(300):
        own = [f"statement {j} of the file {k} alone = {j * k}" for j in range(20)]
        texts.append("\n".join(licence + own))
    texts += ["\n".join(licence[:6]), "\n".join(licence[:8] + ["one more line of its own here"])]
    rows = [("s", "f", f"t{i}") for i in range(len(texts))]
    edits = spark.createDataFrame([(*r, i, 0, "Edit", "", t, False) for i, (r, t) in enumerate(zip(rows, texts))], EDIT_SCHEMA)
    done = edits.unionByName(edits.selectExpr("session_id", "file_path", "task_id", "msg_index + 1000 as msg_index", "pos", "tool_name",
                                              "new_string as old_string", "'' as new_string", "replace_all"))
    prepared = E.prepare(done)
    new = prepared.where("adds").selectExpr("session_id", "file_path", "new_id as id", "new_string as text")
    old = prepared.where("probes").selectExpr("session_id", "file_path", "old_id as id", "old_string as text")
    texts_df = E.roles(new, old, E.FILE).selectExpr("*", "transform(split(text, '\n'), x -> xxhash64(x)) as lines")
    pairs = E.shared_lines(texts_df, E.FILE).collect()
    assert len(pairs) < 5 * len(texts)  # not the square
    want = lineage(spark, [tuple(r) for r in done.collect()], stage)
    assert want == replay([tuple(r) for r in done.collect()])
    anchored = stage(E.with_anchors(texts_df, E.FILE))
    assert E.contained_pairs(anchored, E.FILE).count() <= len(texts)


@pytest.mark.parametrize("seed", range(2))
def test_line_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"a line with some words in it, number {i}" for i in range(30)]
    texts = {f"t{k}": sorted({pool[min(29, int(rng.expovariate(0.15)))] for _ in range(rng.randint(1, 14))}) for k in range(60)}
    rows = [("s", "f", k, v, rng.random() < 0.7, rng.random() < 0.7) for k, v in texts.items()]
    df = spark.createDataFrame(rows, "session_id string, file_path string, id string, words array<string>, is_new boolean, is_old boolean")
    df = df.selectExpr("session_id", "file_path", "id", "is_new", "is_old", "transform(words, x -> xxhash64(x)) as lines")
    got = {(r.new_id, r.old_id): r.shared for r in E.shared_lines(df, E.FILE).collect()}
    for _, _, a, x, new, _ in rows:
        for _, _, b, y, _, old in rows:
            both = len(set(x) & set(y))
            related = a != b and new and old and both and (both / len(set(x) | set(y)) > 0.3 or both / len(y) > 0.5)
            assert not related or got[a, b] == both
            assert (a, b) not in got or got[a, b] == both


def test_texts_meet_only_in_their_era(spark):
    """A Write replaces the file: texts on both sides of it are not compared, whichever way their era takes."""
    text = "first_statement_of_all = 1\nsecond_statement_of_all = 2"
    rows = [("s", "f", "t", 2 * i + j, 0, "Write" if j == 0 else "Edit", "" if j == 0 else f"{text}\nown_statement_number_{i}", f"{text}\nown_statement_number_{i}", False)
            for i in range(6) for j in range(2)]
    edits = stage(E.with_eras(E.prepare(spark.createDataFrame(rows, EDIT_SCHEMA))))
    for limit in (E.DIRECT, 0):
        found = E.text_relations(edits, stage, limit).collect()
        assert len(found) == 6 and {r.tier for r in found} == {"exact"}


@pytest.mark.parametrize("limit", [2000, 0])
def test_long_eras_give_what_short_ones_give(spark, limit):
    rng = random.Random(limit)
    lines = [f"statement_number_{i} = compute({i})" for i in range(8)]
    rows = []
    for i in range(150):
        old, new = ("\n".join(rng.choices(lines, k=rng.randint(1, 4))) for _ in range(2))
        rows.append(("s", f"f{i % 3}", "t", i, 0, "Write" if rng.random() < 0.1 else "Edit", old, new, rng.random() < 0.1))
    edits = stage(E.with_eras(E.prepare(spark.createDataFrame(rows, EDIT_SCHEMA))))
    direct = stage(E.text_relations(edits, stage))
    mixed = E.text_relations(edits, stage, limit).join(direct.select(*E.ERA, "new_id", "old_id").distinct(), [*E.ERA, "new_id", "old_id"], "left_semi")
    # the long way also finds pairs whose new text never stands before the old one
    kept = lambda df: sorted((r.file_path, r.era, r.new_id, r.old_id, r.tier or "", round(r.ratio or 0, 9), r.kills) for r in df.collect())
    assert kept(mixed) == kept(direct) != []


def test_eras_of_one_piece_are_compared_where_they_stand(spark):
    """Only eras that lie in several pieces are sent on with their texts."""
    text = "first_statement_of_all = 1\nsecond_statement_of_all = 2"
    at = [*range(6), *range(E.BLOCK - 3, E.BLOCK + 3), *range(E.BLOCK + 100, E.BLOCK + 106)]
    rows = [("s", "f", "t", i, 0, "Write" if k % 6 == 0 else "Edit", "" if k % 6 == 0 else text, text, False) for k, i in enumerate(at)]
    edits = E.with_eras(E.prepare(spark.createDataFrame(rows, EDIT_SCHEMA)))
    whole, parted, much = (sorted(r.msg_index for r in df.collect()) for df in E.by_place(edits))
    assert (whole, parted, much) == (at[:6] + at[12:], at[6:12], [])
    assert sorted(r.msg_index for r in E.by_place(edits, 0)[2].collect()) == at
    assert lineage(spark, rows, stage) == replay(rows) != Counter()
    sent = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    there = E.by_place(edits)[0]
    assert sent(E.near_relations(there, [*S.PIECE, *E.ERA])) == sent(there)


def test_rounds_of_chain_depth_are_deleted(spark):
    kept = []

    def noted(df, name="stage"):
        kept.append(stage(df, name))
        return kept[-1]

    got = depths_of(spark, [("s", i, i + 1) for i in range(40)], noted)
    assert got["s", 40] == 40
    left = [df._stage_path for df in kept if os.path.exists(df._stage_path.removeprefix("file:"))]
    assert len(kept) > 6 and len(left) <= 2  # the edges and the last depths


def test_edit_signals_are_the_same_on_both_ways(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(40)]
    events = spark.createDataFrame(
        [("s", i // 20, f"f{i % 2}", i, 0, texts[rng.randrange(40)], texts[rng.randrange(40)]) for i in range(80)],
        "session_id string, task_n long, file_path string, msg_index long, pos int, old_string string, new_string string")
    errors = spark.createDataFrame([("s", 0, 5)], "session_id string, task_n long, msg_index long")
    tasks = spark.createDataFrame([("s", i, "") for i in range(4)], "session_id string, task_n long, next_user_message string")
    direct, mixed, far = (sorted(tuple(r) for r in E.edit_signals(events, errors, tasks, limit=n).collect()) for n in (E.DIRECT, 600, 0))
    assert direct == mixed == far and sum(r[3] for r in direct) > 0


def test_texts_of_short_eras_go_to_no_stage(spark):
    rng = random.Random(3)
    texts = [" ".join(str(rng.random()) for _ in range(20)) for _ in range(12)]
    rows = [("s", f"f{i % 2}", "t", i * 300, 0, "Write" if i % 9 == 0 else "Edit", "" if i % 9 == 0 else rng.choice(texts), rng.choice(texts), i % 7 == 0)
            for i in range(60)]
    held = []
    def keep(df, name):
        kept = stage(df, name)
        if "new_string" in kept.columns:
            held.append(kept.where("old_string is not null or new_string is not null").count())
        return kept
    assert lineage(spark, rows, keep) == replay(rows)
    assert held == [0]


def test_edits_in_pieces_give_what_others_give(spark):
    from taskloom.operators import scan as S

    rng = random.Random(4)
    texts = ["\n".join(f"line number {rng.randint(0, 9)} of a text" for _ in range(3)) for _ in range(10)]
    rows = [("s", rng.choice("fg"), "t", i * 611, 0, "Write" if i % 17 == 0 else "Edit", "" if i % 17 == 0 else rng.choice(texts), rng.choice(texts), False)
            for i in range(70)]
    df = spark.createDataFrame(rows, EDIT_SCHEMA)
    cut = S.pieces(df, E.FILE, S.index_chunk("msg_index"))
    got = E.overlaps(E.prepare(cut), stage).collect()
    assert Counter((r.session_id, r.file_path, r.edit_a_index, r.edit_b_index, r.tier, round(r.ratio, 9)) for r in got) == replay(rows)
    # sums per piece tell the eras of much text, wherever their edits stand
    eras = E.with_eras(E.prepare(cut))
    loads = {}
    for r in eras.collect():
        n, chars = loads.get((r.file_path, r.era), (0, 0))
        loads[r.file_path, r.era] = n + 1, chars + r.chars
    limit = sorted(n * c for n, c in loads.values())[len(loads) // 2]
    much = {k for k, (n, c) in loads.items() if n * c > limit}
    out = E.compared(eras, limit).collect()
    assert much and {(r.file_path, r.era) for r in out if r.new_string is not None} == much
    assert sum(r.edit is not None for r in out) == len(rows)
