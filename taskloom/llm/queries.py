"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taskloom.llm import lm, toxicity
from taskloom.llm.columns import whole_text
from taskloom.llm.decontaminate import find
from taskloom.llm.fim import fill_in_middle, restore
from taskloom.llm.html import extract
from taskloom.llm.jaccard import jaccard_components
from taskloom.llm.mixing import mix
from taskloom.llm.quality import score
from taskloom.llm.runs import periodic_runs
from taskloom.llm.secrets import RULES, scan
from taskloom.llm.sharding import shards
from taskloom.llm.substrings import digest, remove_repeats
from taskloom.llm.tokens import token_counts

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_secret_scan")
def op1_secret_scan(spark, folder):
    found = scan(table(spark, folder, "documents"), RULES)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"),
                        line(F.col("spans")).alias("spans"))


@query("op2_decontamination")
def op2_decontamination(spark, folder):
    return find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_html_extraction")
def op3_html_extraction(spark, folder):
    return extract(table(spark, folder, "pages"))


@query("op4_quality_rules")
def op4_quality_rules(spark, folder):
    done = score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept")


@query("op5_toxicity")
def op5_toxicity(spark, folder):
    done = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark, folder):
    return digest(remove_repeats(table(spark, folder, "documents")))


@query("op7_jaccard_join")
def op7_jaccard_join(spark, folder):
    return jaccard_components(table(spark, folder, "documents"))


@query("op8_mixing")
def op8_mixing(spark, folder):
    mixed = mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query("op9_sharding")
def op9_sharding(spark, folder):
    return shards(table(spark, folder, "documents"))


@query("op10_lm_scoring")
def op10_lm_scoring(spark, folder):
    return lm.score(table(spark, folder, "documents"))


@query("op11_fill_in_middle")
def op11_fill_in_middle(spark, folder):
    done = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"), seed=1, rate=90, suffix_first=20)
    fim = F.col("fim")
    return done.select("doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix_chars"].alias("prefix_chars"),
                       fim["middle_chars"].alias("middle_chars"), F.sha2(fim["output"], 256).alias("output_sha256"),
                       F.sha2(restore(fim["output"], fim["form"]), 256).alias("restored_sha256"))


@query("op12_token_counts")
def op12_token_counts(spark, folder):
    import public_tokenizers

    done = token_counts(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return done.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", "tokens.over_limit", "tokens.fits")


@F.arrow_udf(StringType())
def planted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts whose words from a on repeat those from a to a + p; a and p follow from the number beside the text. Null stays null."""

    def plant(text: bytes, g: int) -> str:
        words = text.split()
        n = len(words)
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            block = words[a:a + p]
            words[a:] = (block * ((n - a) // p + 1))[:n - a]
        return b" ".join(words).decode()

    for texts, numbers in batches:
        yield pa.array([None if g is None else plant(t.as_buffer().to_pybytes(), g) for t, g in zip(texts, numbers.to_pylist())], pa.string())


@query("op13_periodic_runs")
def op13_periodic_runs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", whole_text().alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10).cast("long")))
    docs = docs.select("doc_id", F.coalesce(planted(F.when(F.col("g").isNotNull(), F.col("text")), "g"), "text").alias("text"))
    runs = F.col("periodic.runs")
    # greatest length first, then smallest start, then smallest period
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    done = periodic_runs(docs).select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
                                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.p")
    return done.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("1000 * best.length div -best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
