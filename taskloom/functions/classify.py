"""Row classifiers: type, complexity, domain, directives, tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions import patterns as P
from taskloom.functions import text as T


def task_types(prompt: Column) -> Column:
    """Every type that matches, in rule order; ['unknown'] when none does."""
    def found(low: Column) -> Column:
        return F.array_compact(
            F.array(*[F.when(T.any_low(low, pats, True), F.lit(name)) for name, pats in P.TASK_TYPES.items()]))
    return _or_default(T.on_lower(prompt, found), "unknown")


def _or_default(hits: Column, default: str) -> Column:
    """The list itself, or a list of the default; ``hits`` is computed once."""
    return F.element_at(F.transform(
        F.array(hits), lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.lit(default)))), 1)


def type_signals(prompt: Column) -> Column:
    """First matching pattern of every type, as ``type: matched 'pattern'``."""
    def found(low: Column) -> Column:
        parts = []
        for name, pats in P.TASK_TYPES.items():
            rule = None
            for p in pats:
                text = F.lit(f"{name}: matched '{p}'")
                hit = T.matches_low(low, p, True)
                rule = F.when(hit, text) if rule is None else rule.when(hit, text)
            parts.append(rule)
        return F.array_compact(F.array(*parts))
    return _or_default(T.on_lower(prompt, found), "unknown: no patterns matched")


def complexity(tools: Column, files: Column, lines: Column) -> Column:
    """C4: first level whose three limits all hold, else major."""
    rule = None
    for level, max_tools, max_files, max_lines in P.COMPLEXITY_LIMITS:
        fits = (tools <= max_tools) & (files <= max_files) & (lines <= max_lines)
        rule = F.when(fits, level) if rule is None else rule.when(fits, level)
    return rule.otherwise("major")


def complexity_signals(prompt: Column, tools: Column, files: Column, lines: Column) -> Column:
    words = T.on_lower(prompt, lambda low: F.array_compact(F.array(*[
        F.when(T.matches_low(low, p), F.lit(f"{level}: prompt matched '{p}'")) for level, p in P.COMPLEXITY_WORDS])))
    measured = F.concat(
        complexity(tools, files, lines), F.lit(": tools="), tools.cast("string"),
        F.lit(", files="), files.cast("string"), F.lit(", lines="), lines.cast("string"),
    )
    return F.concat(words, F.array(measured))


def domain_hits(path: Column) -> dict[str, Column]:
    """One boolean column per domain for a single path."""
    return {name: T.matches(path, "(?i)(?:" + "|".join(pats) + ")") for name, pats in P.DOMAINS.items()}


def domain_from_counts(counts: dict[str, Column]) -> Column:
    """Best domain, ``mixed`` when the runner-up has 70 % of it, ``unknown`` when all are 0."""
    scored = F.sort_array(
        F.array(*[
            F.struct(F.coalesce(c, F.lit(0)).cast("long").alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("d"))
            for i, (name, c) in enumerate(counts.items())
        ]),
        asc=False,
    )
    best, second = scored[0], scored[1]
    return (
        F.when(best["n"] == 0, "unknown")
        .when(second["n"] >= best["n"] * F.lit(0.7), "mixed")
        .otherwise(best["d"])
    )


def domain_of_files(files: Column) -> Column:
    """C5 over an array column of paths."""
    def hits(name: str) -> Column:
        return F.size(F.filter(files, lambda p: domain_hits(p)[name]))
    return domain_from_counts({name: hits(name) for name in P.DOMAINS})


def confidence(n_signals: Column, primary: Column) -> Column:
    """C6."""
    base = F.least(F.lit(1.0), n_signals * F.lit(0.3))
    return F.when(primary == "unknown", base * 0.5).otherwise(base)


def classification(prompt: Column, tools: Column, files: Column, lines: Column, paths: Column) -> Column:
    """C3-C6 as the nested ``classification`` struct."""
    types = task_types(prompt)
    signals = type_signals(prompt)
    return F.struct(
        types[0].alias("type"),
        F.slice(types, 2, len(P.TYPE_NAMES)).alias("secondary_types"),
        complexity(tools, files, lines).alias("complexity"),
        domain_of_files(paths).alias("domain"),
        confidence(F.size(signals), types[0]).alias("confidence"),
        F.concat(signals, complexity_signals(prompt, tools, files, lines)).alias("signals"),
    )


def agent_directive(prompt: Column) -> Column:
    """C14."""
    return T.on_lower(prompt, lambda low: F.when(T.contains_any(low, P.PARALLEL_WORDS), "parallel").when(
        T.any_low(low, P.USE_AGENT_PATTERNS), "use_agents"))


def wants_agents(prompt: Column) -> Column:
    """C15."""
    return T.on_lower(prompt, lambda low: T.contains_any(low, P.AGENT_WORDS))


def wants_planning(prompt: Column) -> Column:
    """C15."""
    return T.on_lower(prompt, lambda low: T.contains_any(low, P.PLANNING_WORDS))


def tool_class(name: Column, research=P.RESEARCH_TOOLS, implementation=P.WRITE_TOOLS) -> Column:
    """C16."""
    return (
        F.when(name.isin(list(research)), "research")
        .when(name.isin(list(implementation)), "implementation")
        .otherwise("other")
    )


def looks_like_error(result_text: Column) -> Column:
    """Error wording in a tool result."""
    return F.coalesce(T.matches(result_text, "(?i)(?:" + "|".join(P.ERROR_TEXT) + ")"), F.lit(False))


def changes_files(command: Column) -> Column:
    """C20: shell command that rewrites a file."""
    return T.matches(command, P.SHELL_FILE_CHANGE)


def used_planning(flag: Column, tool_names: Column) -> Column:
    """Stored flag, else presence of the planning tool."""
    return F.coalesce(flag, F.array_contains(tool_names, "EnterPlanMode"), F.lit(False))
