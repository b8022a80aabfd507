"""Text helpers and message predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions import patterns as P

WHITESPACE = " \t\n\r\x0b\x0c"


def rx(pattern: str) -> str:
    """Unicode word classes, and only ``\\n`` ends a line, on every JDK."""
    return f"(?Ud){pattern}"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(rx(pattern)))


def matches_any(text: Column, pats: Iterable[str]) -> Column:
    """One alternation instead of one scan per pattern."""
    return matches(text, "|".join(f"(?:{p})" for p in pats))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])


def required_words(pattern: str) -> list[str]:
    """Literals of which a match must contain at least one; [] when there is no such set."""

    def of_sequence(items) -> list[str]:
        runs, run = [], ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            if run:
                runs.append([run])
                run = ""
            if name == "SUBPATTERN":
                runs.append(of_sequence(arg[3]))
            elif name == "BRANCH":
                parts = [of_sequence(x) for x in arg[1]]
                if all(parts):
                    runs.append([w for part in parts for w in part])
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                runs.append(of_sequence(arg[2]))
        runs.append([run] if run else [])
        useful = [r for r in runs if r and min(map(len, r)) >= 2]
        return max(useful, key=lambda r: (min(map(len, r)), -len(r)), default=[])

    return of_sequence(re._parser.parse(pattern))


def matches_low(low: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``matches`` on lower-case text: a substring search rules out most texts before the regex runs."""
    words = required_words(pattern)
    regex = matches(low, f"(?i:{pattern})" if ignore_case else pattern)
    if not words:
        return regex
    return contains_any(low, [w.lower() if ignore_case else w for w in words]) & regex


def on_lower(text: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` applied to the lower-case text, which is computed once per row.

    A plain ``lower(text)`` inside a rule of a hundred branches would be
    evaluated again in every branch.
    """
    return F.element_at(F.transform(F.array(F.lower(text)), rule), 1)


def any_low(low: Column, pats: Iterable[str], ignore_case: bool = False) -> Column:
    return reduce(lambda x, y: x | y, [matches_low(low, p, ignore_case) for p in pats])


def count_matching(low: Column, pats: Iterable[str]) -> Column:
    """How many of the patterns hit the lower-case text at least once."""
    return reduce(lambda x, y: x + y, [matches_low(low, p).cast("int") for p in pats])


def is_skipped(text: Column, tags: list[str] | None = None) -> Column:
    """P2 (and P25 with the basic tags): system-tag or blank message."""
    return matches_any(stripped(text), tags or P.SKIP_TAGS)


def is_generated(text: Column) -> Column:
    """Text written by the client, not by a person."""
    return matches(stripped(text), "(?i)(?:" + "|".join(P.GENERATED_TEXT) + ")")


def line_count(text: Column) -> Column:
    """Lines of a non-empty text, 0 when empty or null."""
    return F.when(
        F.length(text) > 0,
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
    ).otherwise(F.lit(0)).cast("long")


# --- P21: labels, only for the last select ----------------------------------
def task_summary(prompt: Column, tools: Column, files: Column) -> Column:
    head = F.replace(F.substring(prompt, 1, 60), F.lit("\n"), F.lit(" "))
    return F.concat(
        head, F.lit("... ("), tools.cast("string"), F.lit(" tools, "),
        files.cast("string"), F.lit(" files)"),
    )


def magnitude(value: Column) -> Column:
    """1234567 -> 1.2M, 2.5e9 -> 2.5B."""
    return (
        F.when(value >= 1e9, F.format_string("%.1fB", value.cast("double") / 1e9))
        .when(value >= 1e6, F.format_string("%.1fM", value.cast("double") / 1e6))
        .otherwise(F.format_number(value, 0))
    )


def seconds_label(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.0fs", seconds.cast("double")))
        .otherwise(F.format_string("%.1fm", seconds.cast("double") / 60))
    )


def percent_label(share: Column) -> Column:
    return F.format_string("%.1f%%", share.cast("double"))


def points_label(delta: Column) -> Column:
    return F.format_string("%+.1fpp", delta.cast("double"))


def cache_key(*parts: Column, length: int = 16) -> Column:
    """SHA-256 hex prefix of the joined parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)
