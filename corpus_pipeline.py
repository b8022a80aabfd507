"""From raw documents to balanced training shards, one operator per stage.

Every stage reads what its predecessor wrote and returns the columns of
``documents``; the last returns where each row goes. The near-duplicate stage
knows rows by id and text, so null and repeated ids are deduplicated as others
are. The mixing stage repeats a document once per copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import decontaminate, mixing, quality, sharding
from taskloom.llm.jaccard import representatives
from taskloom.sources.stage import discard, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guarded(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that no operator reads under names that none uses, and the columns that bring them back."""
    named = {c: c if c in ("doc_id", "text", "source") else f"_own_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in named.items()]), [F.col(n).alias(c) for c, n in named.items()]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like the trusted ones."""
    apart, back = guarded(docs)
    return quality.score(apart, table(spark, sf_dir, "labels")).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: the smallest id, nulls last. Without words and id, every row is a group."""
    keep = stage(representatives(docs).toDF("_id", "_hash", "_single"), "representatives")
    kept = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash")))
    kept = kept.withColumn("_row", F.when(F.col("_single"), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long")))
    return kept.dropDuplicates(["_id", "_hash", "_row"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    apart, back = guarded(docs)
    taken = mixing.mix(apart).where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return taken.select(*back)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mix_sources),
    ("sharding", into_shards),
]

#: The log ratio, the Newton steps and the rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if done is not None:
            discard(done)
        done = docs
    return docs
