"""Result columns that never replace a column of the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(column: str = "text") -> Column:
    """The text as a string; null becomes empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
