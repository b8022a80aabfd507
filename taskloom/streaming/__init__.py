"""Incremental ingestion of session logs.

The analysed pipeline has no stream operators. It re-reads only files whose
content changed; ``ingest`` is the counterpart: a file stream that appends the
lines of new session files to a table and stops when it has caught up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Write the lines of session files not seen before, in file order, to ``target/batch=<n>``.

    A repeated batch overwrites its own directory, so every file is taken once.
    """
    lines = (
        spark.readStream.schema(StructType([StructField("value", StringType())]))
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").format("text").load(source)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), "value")
        .where(~F.col("file_path").rlike(r"/agent-[^/]*\.jsonl$"))
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("line", F.monotonically_increasing_id()).write.mode("overwrite").parquet(
            f"{target}/batch={number}")

    return (
        lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
