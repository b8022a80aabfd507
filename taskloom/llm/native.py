"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    """Number of words of a text, without an array of them: each word and the blanks after it shrink to one letter."""
    start = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(start, r"[^ \t-\r]++[ \t-\r]*+", "w")).cast("long")


def total(values: Column, zero: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(zero), lambda acc, x: acc + x)
