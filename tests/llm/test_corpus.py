from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taskloom.llm.mixing import mix
from taskloom.llm.sharding import shards

from .conftest import SF, words
from .test_text_operators import rows


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        open_ = sum(w for s, w in weight.items() if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        more = [s for s in names if s not in full and target[s] > 2 * sizes[s] + 1e-9]
        if not more:
            return target
        full.update(more)


def test_mixing(documents, odd):
    for df in (documents, odd):
        got = rows(mix(df))
        assert len(got) == df.count()
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in got:
            assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        target = brute_targets(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
        if df is documents:  # ten documents a source
            assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] for s in sizes)
    key = lambda r: str((r.doc_id, r.taken))
    assert sorted(map(key, rows(mix(documents)))) == sorted(map(key, rows(mix(documents.repartition(7)))))


def test_differences_close_a_gap():
    import pandas as pd

    from taskloom.llm.mixing import differences

    for gap in (-731.0, -3.0, 0.6, 9.0, 250.0, 3000.0):
        pdf = pd.DataFrame({"size": [400, 93, 90, 17], "more": [1, 2, 0, 5], "less": [3, 1, 1, 0]}).assign(source=None, gap=gap)
        got = differences((None,), pdf)
        moved = int((got["size"] * got["change"]).sum())
        more, less = (dict(zip(pdf["size"], pdf[c])) for c in ("more", "less"))
        assert all(-less[s] <= c <= more[s] for s, c in zip(got["size"], got["change"]))
        reachable = 400 + 2 * 93 + 5 * 17 if gap > 0 else 3 * 400 + 93 + 90
        assert abs(gap - moved) <= (abs(gap) - reachable if abs(gap) > reachable else 200)


def test_mixing_of_equal_rows_and_clashing_names(spark):
    text = " ".join(["w"] * 50)
    data = [(1, text, "a", k) for k in range(7)] + [(None, text, "a", k) for k in range(5)] + [(2, text + " v", "a", 0), (3, text * 3, "b", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, mark int").withColumn("k", F.lit("mine"))
    got = rows(mix(df))
    assert len(got) == len(data) and {r.k for r in got} == {"mine"}
    same = [r.copies for r in got if r.doc_id == 1]
    assert max(same) - min(same) <= 1 and len({r.mark for r in got if r.doc_id == 1}) == 7


def test_sharding(documents, odd, empty):
    for df in (documents, odd):
        got = sorted(rows(shards(df)), key=lambda r: (r.shard, r.slot))
        assert len(got) == df.count()
        ids = [-1 if r.doc_id is None else r.doc_id for r in got]
        assert ids == sorted(ids)
        total = sum(r.size for r in got)
        for s in range(16):
            own = [r for r in got if r.shard == s]
            assert [r.slot for r in own] == list(range(len(own)))
            if df is documents:
                assert abs(sum(r.size for r in own) - total / 16) <= max(r.size for r in got)
    sizes = Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in rows(odd))
    assert Counter((r.doc_id, r.size) for r in rows(shards(odd))) == sizes
    assert rows(shards(empty)) == [] and rows(mix(empty)) == []


def test_pipeline(spark, documents):
    docs, seen = documents, []
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), "test")
        seen.append((name, docs))
    assert [n for n, _ in seen] == ["quality rules", "near duplicates", "benchmark decontamination", "source mixing", "sharding"]
    assert all(d.columns == documents.columns for _, d in seen[:-1])
    first, second, third, fourth, last = (d for _, d in seen)
    # each stage against the operator it calls
    from taskloom.llm import decontaminate, quality
    from taskloom.llm.jaccard import jaccard_components
    from .conftest import table

    ids = lambda df: sorted(r.doc_id for r in rows(df.select("doc_id")))
    assert ids(first) == ids(quality.score(documents, table(spark, "labels")).where("kept"))
    assert ids(second) == ids(jaccard_components(first).where("doc_id = component_id"))
    leaked = {r.doc_id for r in rows(decontaminate.find(second, table(spark, "benchmark")))}
    assert ids(third) == [i for i in ids(second) if i not in leaked] and leaked
    copies = Counter(ids(fourth))
    assert copies == Counter({r.doc_id: r.copies for r in rows(mix(third)) if r.copies})
    assert ids(last) == ids(fourth)
    assert sorted(tuple(r) for r in rows(corpus_pipeline.run(spark, SF).drop("grown_shard"))) == sorted(tuple(r) for r in rows(last.drop("grown_shard")))


def test_pipeline_odd_rows(spark, odd):
    docs = odd.unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(4).cast("long"))).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in rows(kept)) == sorted(["1", "2", "3", "4", "6", "7", "9"])  # the row without id is a copy of document 4
    for _, step in corpus_pipeline.STAGES[2:]:
        docs = step(spark, docs, SF)
    assert docs.count() > 0


def test_pipeline_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(3, a), (5, b), (5, a), (5, b), (None, a), (None, b + " more"), (None, c), (None, c), (None, c + " more"), (8, c + " end"), (None, " "),
            (None, " "), (9, None), (9, None), (None, "only one"), (None, "only one")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in rows(corpus_pipeline.near_duplicates(spark, docs, SF))]
    expected = [(3, a), (5, b), (8, c + " end"), (None, " "), (None, " "), (9, None), (None, "only one")]
    assert sorted(kept, key=str) == sorted(expected, key=str)


def test_pipeline_clashing_names_and_empty_tables(spark, documents):
    own = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("size", "kept", "copies", "n_words", "log_ratio", "target", "row")}
    docs = documents.limit(60).withColumns(own)
    for step in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.mix_sources):
        done = step(spark, docs, SF)
        assert done.columns == docs.columns and done.schema == docs.schema
        got = rows(done)
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in own)
    docs = documents.limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), "empty")
        assert rows(docs) == []
