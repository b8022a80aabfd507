"""Registration of queries with their SQL equivalents, and helpers both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent for another engine, if SQL can say it."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when a scan has fewer splits than cores, for work that is heavy per row.

    A large table has more splits than cores and is returned as it is. ``key``
    is unique, and a hash by key needs no sort.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Last select of a query: whole numbers as long, fractions rounded."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- SQL text shared by several equivalents ----------------------------------
BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NW = r"[^\p{L}\p{N}_]"


def portable(pattern: str) -> str:
    """A word-boundary pattern for an engine whose ``\\b`` is ASCII only."""
    p = pattern.replace(r"\b.*\b", f"(?:{NW}|{NW}.*{NW})")
    if p.startswith(r"\b"):
        p = f"(?:^|{NW})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + f"(?:$|{NW})"
    return p


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(column: str, pattern: str, flags: str = "") -> str:
    p = portable(pattern)
    return f"regexp_matches({column}, {quoted(flags + p)})"


def any_hit(column: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " or ".join(hit(column, p, flags) for p in patterns) + ")"


def count_hits(column: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"{hit(column, p)}::int" for p in patterns) + ")"
