"""Anonymised and aggregate outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import signals as G
from taskloom.operators import dataset as D
from taskloom.operators import scan as S


def project_labels(tables: list[DataFrame], project: str = "project_path") -> DataFrame:
    """``project-NN`` by sorted rank over all tables."""
    names = reduce(lambda x, y: x.unionByName(y), [t.select(F.col(project).alias("project")) for t in tables])
    names = names.where("project <> ''").distinct().withColumn("_all", F.lit(0))
    ranked = S.ordered(S.with_name_ranges(names, "project"), ["_all"], ["project"], F.col("_block"), nth=S.position())
    return ranked.select("project", F.concat(F.lit("project-"), label_number(F.col("nth"))).alias("label"))


def label_number(n: Column) -> Column:
    """At least two digits."""
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def neutral_home(text: Column, home: str, neutral: str = "/home/user") -> Column:
    return F.replace(text, F.lit(home), F.lit(neutral))


def anonymise(df: DataFrame, labels: DataFrame, text_columns: list[str], home: str, project: str = "project_path",
              path_column: str | None = "file_path") -> DataFrame:
    """Own project by its label, the home folder neutral, absolute paths redacted.

    Text columns replace the project of their own row; ``scrub_mentions`` also
    replaces other projects named in a text.
    """
    j = df.join(labels.withColumnRenamed("project", "_p").withColumnRenamed("label", "_l"),
                F.col(project) == F.col("_p"), "left")
    def clean(name: str) -> Column:
        c = neutral_home(F.col(name), home)
        c = F.when(F.col("_p").isNotNull(), F.replace(c, F.col("_p"), F.col("_l"))).otherwise(c)
        return c.alias(name)
    out = []
    for name in df.columns:
        if name == project:
            out.append(F.coalesce("_l", F.col(project)).alias(project))
        elif name == path_column:
            c = F.col(name)
            out.append(F.when(c.startswith("/"), "[redacted]").otherwise(neutral_home(c, home)).alias(name))
        else:
            out.append(clean(name) if name in text_columns else F.col(name))
    return j.select(*out)


def scrub_mentions(df: DataFrame, labels: DataFrame, ident: str, text: str, token: str = r"[\w.\-/]+") -> DataFrame:
    """Replace every project that a path token of a text begins with (whole path parts), the longest one first.

    A token is looked up by each of its leading parts (``/a/b/c`` asks for
    ``/a``, ``/a/b`` and ``/a/b/c``): an equi-join whose rows follow the text and
    not the number of projects. Distinct tokens of the whole table are looked up
    once; a text then meets the answers of its own tokens.
    """
    found = df.select(ident, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({token})"), 1))).alias("token"))
    parts = F.split("token", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    asked = found.select("token").distinct().select("token", F.explode(heads).alias("project")).where("project <> ''")
    best = asked.join(labels, "project").groupBy("token").agg(F.max_by(F.struct("project", "label"), F.length("project")).alias("hit"))
    named = found.join(best, "token").select(
        ident, F.struct("token", F.concat("hit.label", F.expr("substring(token, length(hit.project) + 1)")).alias("to")).alias("hit"))
    hits = named.groupBy(ident).agg(F.map_from_entries(F.collect_list("hit")).alias("_hits"))  # at most the tokens of the text
    pieces = F.regexp_extract_all(text, F.lit(f"({token}|(?s:.))"), 1)
    cleaned = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("_hits", p), p)), "")
    return df.join(hits, ident, "left").withColumn(text, F.when(F.col("_hits").isNull(), F.col(text)).otherwise(cleaned)).drop("_hits")


def leaks(df: DataFrame, text_columns: list[str], needles: list[str]) -> DataFrame:
    """Rows that still hold a private string after anonymising."""
    found = reduce(lambda x, y: x | y, [F.col(c).contains(n) for c in text_columns for n in needles])
    return df.where(found)


def public_aggregates(tasks: DataFrame, annotated: DataFrame) -> DataFrame:
    """Distributions per cohort as (cohort, measure, value, count, pct)."""
    t = tasks.select("cohort", F.inline(F.array(
        F.struct(F.lit("outcome").alias("measure"), F.coalesce("outcome_category", F.lit("unknown")).alias("value")),
        F.struct(F.lit("complexity").alias("measure"), F.col("classification.complexity").alias("value")),
        F.struct(F.lit("type").alias("measure"), F.col("classification.type").alias("value")))))
    a = annotated.select("cohort", F.inline(F.array(
        F.struct(F.lit("sentiment").alias("measure"), G.sentiment_bucket(F.col("user_sentiment")).alias("value")),
        F.struct(F.lit("completion").alias("measure"), F.lower("task_completion").alias("value")))))
    return D.distribution(t.unionByName(a), ["cohort", "measure"], "value")
