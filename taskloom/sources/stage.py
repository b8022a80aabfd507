"""Stage tables: cut the lineage of a long pipeline at its natural borders.

A stage is written as Parquet below the shared folder named by
``spark.checkpoint.dir``, so a lost executor re-reads it instead of replaying
the whole pipeline, and every reader of the stage gets column pruning and
filter pushdown.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="taskloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._stage_path = path
    return written


def discard(*stages: DataFrame) -> None:
    """Delete the files of stages that only written tables were made from; frames that still read them would fail. Other frames are left as they are."""
    for df in (x for x in stages if hasattr(x, "_stage_path")):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
