"""Outcome and completion signals from the next user message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions import patterns as P
from taskloom.functions import text as T

OUTCOME_TYPE = "struct<category:string,evidence:string>"


def _outcome(category: str, evidence: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(evidence).alias("evidence"))


def _asks_about_fix(text: Column, pattern: str) -> Column:
    """True if the 20 characters around the first match form a question."""
    regex = F.lit(T.rx(pattern))
    first = F.regexp_instr(text, regex)
    size = F.length(F.regexp_substr(text, regex))
    left = F.greatest(first - 20, F.lit(1))
    around = F.substring(text, left, first + size + 20 - left)
    return T.matches(around, P.QUESTION_ABOUT_FIX)


def outcome(text: Column) -> Column:
    """First rule that holds, as struct(category, evidence)."""
    return F.when(T.is_generated(text), _outcome("system_continuation", "auto-generated")).otherwise(
        T.on_lower(T.stripped(text), _person_outcome)
    )


def _person_outcome(low: Column) -> Column:
    rule = F.when(F.lit(False), _outcome("", ""))
    for pattern, evidence in P.PLEASED:
        rule = rule.when(T.matches_low(low, pattern), _outcome("satisfaction", evidence))
    for pattern, evidence in P.DISPLEASED:
        rule = rule.when(
            T.matches_low(low, pattern) & ~_asks_about_fix(low, pattern),
            _outcome("dissatisfaction", evidence),
        )
    for pattern, evidence in P.CARRYING_ON:
        rule = rule.when(T.matches_low(low, pattern), _outcome("continuation", evidence))
    return rule.when(F.length(low) > 20, _outcome("new_task", "new request")).otherwise(
        _outcome("unclear", "")
    )


def task_outcome(next_text: Column) -> Column:
    """C1 with the last task of a session (no next message) as session_end."""
    return F.when(next_text.isNull(), _outcome("session_end", "session terminated")).otherwise(
        outcome(next_text)
    )


def completion_signal(next_text: Column) -> Column:
    """Signal of the basic segmentation."""
    signal = T.on_lower(next_text, lambda low: (
        F.when(T.any_low(low, P.DONE_SIGNALS), "explicit_done")
        .when(T.any_low(low, P.UNHAPPY_SIGNALS), "user_dissatisfied")
        .otherwise("user_continues")
    ))
    return F.when(next_text.isNull(), "session_end").otherwise(signal)
