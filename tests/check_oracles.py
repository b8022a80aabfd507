"""Compare registered queries with their SQL equivalents.

``python tests/check_oracles.py [sf folder] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float, bool)) else "n", v if v is not None else 0)
                 for v in row)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(df, con, sql):
    cols, rows = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    ocols, orows = table_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return len(rows), f"columns {cols} / {ocols}"
    if len(rows) != len(orows):
        return len(rows), f"{len(rows)} rows / {len(orows)}"
    bad = [(a, b) for a, b in zip(rows, orows) if a != b]
    return len(rows), (f"{len(bad)} differing rows, first {bad[0]}" if bad else None)


def kinds(df, con, sql):
    names = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int"}
    theirs = {r[0]: names.get(r[1], r[1]) for r in con.execute(f"describe {sql}").fetchall()}
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return {c: (mine[c], theirs.get(c)) for c in mine if mine[c] != theirs.get(c)}


def main(folder: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                n, problem = compare(df, con, sql[name])
                differ = kinds(df, con, sql[name])
            else:
                n, problem, differ = df.count(), None, {}
            note = "rows only" if name not in sql else "ok"
        except Exception as error:  # noqa: BLE001
            n, problem, differ, note = -1, f"{type(error).__name__}: {str(error)[:600]}", {}, ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else note:9} {name:24} {n:7} rows {time.time() - start:6.1f}s {problem or ''} {differ or ''}",
              flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
