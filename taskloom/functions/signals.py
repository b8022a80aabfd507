"""Keyword votes and annotation normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions import patterns as P
from taskloom.functions import text as T


def keyword_signals(next_text: Column, outcome_category: Column) -> Column:
    """C7 as a struct."""
    def hits(low: Column) -> Column:
        return F.struct(
            T.count_matching(low, P.POSITIVE_WORDS).alias("pos"),
            T.count_matching(low, P.NEGATIVE_WORDS).alias("neg"),
            T.count_matching(low, P.CONTINUING_WORDS).alias("con"))
    def shaped(h: Column) -> Column:
        return F.struct(
            outcome_category.alias("outcome_category"),
            hit_confidence(h["pos"] + h["neg"] + h["con"]).alias("outcome_confidence"),
            h["pos"].alias("positive_hits"), h["neg"].alias("negative_hits"), h["con"].alias("continuation_hits"))
    counted = T.on_lower(F.coalesce(next_text, F.lit("")), hits)
    return F.element_at(F.transform(F.array(counted), shaped), 1)


def hit_confidence(total: Column) -> Column:
    return F.when(total == 0, "low").when(total <= 2, "medium").otherwise("high")


def vote(text: Column, votes: dict[str, list[str]]) -> Column:
    """Category with most hits, first listed wins ties, null without a hit."""
    def best(low: Column) -> Column:
        return F.array_max(F.array(*[
            F.struct(T.count_matching(low, pats).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("c"))
            for i, (name, pats) in enumerate(votes.items())]))
    return F.element_at(F.transform(
        F.array(T.on_lower(text, best)), lambda b: F.when(b["n"] > 0, b["c"])), 1)


def normalised(quality: Column, work: Column, sentiment: Column) -> dict[str, Column]:
    """C10."""
    return {
        "normalized_execution_quality": F.coalesce(vote(quality, P.QUALITY_VOTES), F.lit("adequate")),
        "normalized_work_category": F.coalesce(vote(work, P.WORK_VOTES), F.lit("directed_impl")),
        "normalized_user_sentiment": F.coalesce(vote(sentiment, P.SENTIMENT_VOTES), F.lit("neutral")),
    }


def completion(value: Column) -> Column:
    """C11: one of complete, partial, interrupted, failed."""
    v = F.lower(T.stripped(value))
    return (
        F.when(v.isin(P.COMPLETIONS), v)
        .when(v.startswith("failed"), "failed")
        .when(v == "not_started", "interrupted")
        .otherwise("partial")
    )


def valid_score(value: Column) -> Column:
    """Integer score, 3 when missing or unreadable."""
    return F.coalesce(value.try_cast("int"), F.lit(3))


def valid_type(value: Column, allowed=P.TASK_TYPES) -> Column:
    """Known task type, else ''."""
    v = T.stripped(F.lower(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(list(allowed)), v).otherwise("")


def salvaged_json(raw: Column, opener: str = "{") -> Column:
    """Text between the first opening and the last closing bracket."""
    pattern = r"(?s)\{.*\}" if opener == "{" else r"(?s)\[.*\]"
    return F.regexp_substr(raw, F.lit(pattern))


def sentiment_bucket(value: Column) -> Column:
    """Substring rules; the negative word is tested before the positive one it contains."""
    v = F.lower(value)
    rule = None
    for bucket, words in P.SENTIMENT_SUBSTRINGS:
        hit = T.contains_any(v, words)
        rule = F.when(hit, bucket) if rule is None else rule.when(hit, bucket)
    return rule.otherwise("other")


def fallback_sentiment(positive: Column, negative: Column) -> Column:
    return (
        F.when(negative > positive, "dissatisfied").when(positive > 0, "satisfied").otherwise("neutral")
    )


def keyword_sentiment(positive: Column, negative: Column) -> Column:
    return (
        F.when(positive > negative, "satisfied").when(negative > positive, "dissatisfied").otherwise("neutral")
    )
