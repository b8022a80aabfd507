"""Contiguous shards of equal bytes by global prefix sums (operator 9).

Rows are dealt into ranges of (doc_id, checksum, size) and written once as slim
rows with the number of their range. Totals per range, summed in order, tell
every range where it begins; a window inside each range adds the rest. A row
goes to the shard in whose byte interval its middle falls, so no shard is off
its target by more than one row. The law is ``bytes``: sizes near equal.

Only identifiers and sizes move; texts stay where they are. Equal texts are not
kept together: a group of copies may exceed a shard.

Defined results: a null or empty text has one byte (its separator) and checksum
0; null ids come first; repeated rows follow each other and get a slot each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.sources.stage import stage

ORDER = ["doc_id", "text_crc32", "size"]


def shards(docs: DataFrame, n: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    slim = stage(slim.repartitionByRange(*ORDER).withColumn("range", F.spark_partition_id()), "ranged")

    # one row per range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = slim.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ranges = ranges.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                           F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))

    inside = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumns({"upto": F.sum("size").over(inside), "nth": F.count("*").over(inside)}).join(ranges, "range")
    placed = placed.select(
        *ORDER, (F.col("rows_before") + F.col("nth")).alias("row"),
        F.least(F.lit(n - 1), F.expr(f"(2 * (bytes_before + upto) - size) * {n} div (2 * total)")).cast("int").alias("shard"))
    placed = stage(placed, "placed")
    starts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n rows
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
