"""Secret scan with a trigram inverted index (operator 1).

Each rule is a regular expression. ``trigram_query`` derives from it a Boolean
query: any of several alternatives, each a set of trigrams that a matching text
must hold (letters folded). The index has a posting (trigram, document) for
every trigram of the rule set that a document holds; the postings of an
alternative are intersected by counting them per document, and only candidate
documents are matched. A rule without a mandatory trigram scans every document.

Positions come from the matches and the pieces between them, so verification is
built-in functions as well. Matches are leftmost and do not overlap within a
kind; those that a rule's filter turns down are dropped.

Defined results: a null or empty text has no spans; null and repeated ids are
verified like any other (postings only decide which documents are looked at);
an empty table gives no rows; other columns are kept unless they are called
``spans``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alternatives beyond this number are not told apart; the rule then scans.
ALTERNATIVES = 64
GAP = "\0"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0      # the part of a match whose length counts
    least: int = 1      # its least length


# The three base rules, then rules of this library for formats with a fixed beginning.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]


def literals(pattern: str) -> list[str]:
    """Alternatives of a pattern as literal text, with GAP for what may vary.

    Knows groups, alternation, classes, escapes and quantifiers as rules use
    them; more alternatives than ALTERNATIVES become one GAP.
    """
    at = 0
    pattern = pattern.removeprefix("(?i)")

    def atom() -> list[str]:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            at += 2 if pattern.startswith("?:", at) else 0
            inner = choice()
            at += 1
            return inner
        if c == "[":
            start, at = at, pattern.index("]", at + 1) + 1
            few = pattern[start:at - 1]
            return list(few) if few.isalnum() and len(few) <= 8 else [GAP]
        if c == ".":
            return [GAP]
        if c == "\\":
            c = pattern[at]
            at += 3 if c == "x" else 1
            return [chr(int(pattern[at - 2:at], 16))] if c == "x" else [GAP if c.isalpha() else c]
        return [c]

    def piece() -> list[str]:
        nonlocal at
        found = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            q = pattern[at]
            at = pattern.index("}", at) + 1 if q == "{" else at + 1
            if q == "?":
                found = [*found, ""]
            elif q == "+":
                found = [f + GAP for f in found]
            else:
                found = [GAP]
        return found

    def chain() -> list[str]:
        done = [""]
        while at < len(pattern) and pattern[at] not in "|)":
            more = piece()
            done = [a + b for a in done for b in more]
            if len(done) > ALTERNATIVES:
                done = [GAP]
        return done

    def choice() -> list[str]:
        nonlocal at
        done = chain()
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            done += chain()
        return done

    return choice()


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams; empty if some alternative has none."""
    found = []
    for text in dict.fromkeys(literals(pattern)):
        runs = text.lower().split(GAP)
        found.append(frozenset(r[i:i + 3] for r in runs for i in range(len(r) - 2)))
    return list(dict.fromkeys(found)) if all(found) else []


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id): the inverted index of the given trigrams over letters folded."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = F.filter(F.array(*(F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams)), lambda t: t.isNotNull())
    return docs.select("doc_id", low.alias("_low")).select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(cand_id, kinds): documents that hold all trigrams of an alternative, with the rules to verify."""
    spark = docs.sparkSession
    clauses = [(r.kind, f"{r.kind}/{i}", t, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.pattern)) for t in sorted(alt)]
    if not clauses:
        return spark.createDataFrame([], "cand_id long, kinds array<string>")
    clause = spark.createDataFrame(clauses, "kind string, clause string, trigram string, need int")
    postings = index(docs, sorted({c[2] for c in clauses}))
    # the clause table is as long as the rules; a posting meets a few clauses
    met = postings.join(F.broadcast(clause), "trigram").groupBy("doc_id", "kind", "clause", "need").agg(
        F.count_distinct("trigram").alias("has")).where("has = need")
    return met.groupBy(F.col("doc_id").alias("cand_id")).agg(F.collect_set("kind").alias("kinds"))


def spans_of(rule: Rule, text: Column) -> Column:
    """array<struct<start, kind, end>> of a rule: matches, and the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    piece = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    size = F.transform(found, lambda m: F.length(m))
    judged = size if not rule.group else F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m))
    steps = F.arrays_zip(F.slice(piece, F.lit(1), F.size(size)).alias("gap"), size.alias("size"), judged.alias("judged"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,judged:int>>").alias("out"))
    walked = F.aggregate(steps, zero, lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + s["size"]).alias("at"),
        F.array_append(acc["out"], F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end"),
                                            s["judged"].alias("judged"))).alias("out")))
    kept = F.filter(walked["out"], lambda s: s["judged"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """docs without text, with spans: array of (start, kind, end), by start and then by the order of the rules."""
    kinds = [r.kind for r in rules]
    found = candidates(docs.select("doc_id", "text"), rules)
    own = [c for c in docs.columns if c not in ("text", "spans")]
    df = docs.select(F.struct(*own).alias("row"), "doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("cand_id")), "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    parts = []
    for r in rules:
        # a full scan first asks whether the text holds a long enough run at all
        gate = F.array_contains(F.col("kinds"), r.kind) if trigram_query(r.pattern) else text.rlike(run_of(r))
        parts.append(F.when(gate, spans_of(r, text)).otherwise(empty))
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    every = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"),
                                                             s["kind"].alias("kind"), s["end"].alias("end")))
    return df.select("row.*", F.array_sort(every).alias("spans"))


def run_of(rule: Rule) -> str:
    """The pattern with the least length put in, where it is one repeated class; else the pattern itself."""
    return rule.pattern[:-1] + "{" + str(rule.least) + "}" if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1 \
        and rule.pattern[0] == "[" else rule.pattern
