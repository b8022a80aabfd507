"""Mixing sources to target weights by entropy balancing (operator 8).

Targets: sources weigh ``weights`` in turn by name and share ``budget`` times
all words; a target stops at ``limit`` times its source, and the excess is
shared again by weight. With sources in the order of limit per weight this is
one running sum.

Rates: each document gets a rate between 0 and ``limit`` so that the words of
its source reach the target, as close to one as possible in relative entropy.
The dual has one multiplier per source, and the rate of a document is
``min(limit, exp(lambda * s / (s + m)))`` for its size s and the mean size m of
its source: a document pays for its words and for being touched at all, so long
texts tilt more than short ones, but never beyond exp(lambda). Newton steps on
the dual, kept inside a shrinking bracket, run as Spark jobs over the counts of
(source, size); a step is one join and one aggregate, and no multiplier passes
through the driver.

Rounding: rates are fixed-point numbers, summed exactly along the documents of a
source (in hashed blocks of about the square root of its rows, long documents
first); a document takes a copy whenever the sum passes a whole number. Of
``STARTS`` first values of the sum each source uses the one whose copies come
nearest to its target. What is then missing or too much is made up by single
copies: the longest documents that fit first, then the exchange of one document
for another that comes nearest. Every sum is over integers, so reruns agree.

Only slim rows (id, checksum of the text, source, size) are sorted and summed;
equal ones count as one row with a number. Whole rows meet their copies in one
join at the end; of rows that agree in id, text and source, which one takes a
copy more is told by their place in the table, so ``docs`` should be a table or
a stage, which gives rows the same places when it is read again.

Defined results: a null or empty text has size 0 and no words to take; the null
source is a source of its own, last in order; null ids and repeated rows take
part as rows of their own; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.llm.native import n_words
from taskloom.operators import scan as S
from taskloom.sources.stage import stage

WEIGHTS = (5, 2, 1)
#: Fixed-point unit of a rate, and of a word in the Newton sums.
UNIT = 1 << 20
GRAIN = 1 << 10
STEPS = 60
STARTS = 64


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = 1.5, limit: int = 2) -> DataFrame:
    """sources (source, source_size, n) with target; one row per source."""
    place = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("weight", turn[(F.row_number().over(place) - 1) % len(weights)])
    s = s.withColumn("room", limit * F.col("source_size"))
    # sources fill up in the order of room per weight; level is what a unit of weight gets once those before are full
    fill = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "full": F.sum("room").over(fill.rowsBetween(Window.unboundedPreceding, -1)),
        "open": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "words": budget * F.sum("source_size").over(whole),
    })
    s = s.withColumn("level", (F.col("words") - F.coalesce("full", F.lit(0))) / F.col("open"))
    # filling a source short of room raises the level, filling one with room to spare lowers it: the highest one holds
    s = s.withColumn("stop", F.max("level").over(whole))
    return s.select("source", "source_size", "n", F.least(F.col("room").cast("double"), F.col("stop") * F.col("weight")).alias("target"))


def rate(size, mean, lam, limit: int):
    return F.least(F.lit(float(limit)), F.exp(lam * size / (size + mean)))


def multipliers(sizes: DataFrame, goal: DataFrame, limit: int) -> DataFrame:
    """goal with lam: Newton steps on the dual of every source. sizes has (source, size, n)."""
    bound = 64.0
    state = stage(goal.select(
        "source", "target", (F.col("source_size") / F.col("n")).alias("mean"),
        F.lit(-bound).alias("low"), F.lit(bound).alias("high"),
        # nothing to solve: an empty source, or one taken whole
        ((F.col("source_size") == 0) | (F.col("target") >= limit * F.col("source_size"))).alias("done"),
        # the multiplier that a source of texts of its mean size would need
        F.greatest(F.lit(-bound / 2), F.least(F.lit(bound / 2), 2 * F.log(F.col("target") / F.col("source_size")))).alias("start")).select(
        "*", F.when(F.col("done"), F.lit(bound)).otherwise(F.coalesce("start", F.lit(0.0))).alias("lam")).drop("start"), "dual")
    salts = 8
    sizes = stage(sizes.where("size > 0").withColumn("salt", F.expr(f"pmod(size, {salts})")), "sizes")
    for _ in range(STEPS):
        if not state.where("not done").take(1):
            break
        # a source with many sizes meets its multiplier in several places
        spread = state.where("not done").select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        met = sizes.alias("h").join(spread.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")) & (F.col("h.salt") == F.col("s.salt")))
        size, tilt = F.col("size"), F.col("size") / (F.col("size") + F.col("mean"))
        r = rate(F.col("size"), F.col("mean"), F.col("lam"), limit)
        fixed = lambda x: F.round(x * GRAIN).cast("long")
        sums = met.select(F.col("s.source").alias("source"), "n", fixed(size * r).alias("w"),
                          fixed(F.when(r < limit, size * r * tilt).otherwise(0.0)).alias("d"))
        sums = sums.groupBy("source").agg((F.sum(F.col("n") * F.col("w")) / GRAIN).alias("got"), (F.sum(F.col("n") * F.col("d")) / GRAIN).alias("slope"))
        now = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "got", "slope")
        over = F.col("got") > F.col("target")
        now = now.withColumns({"low": F.when(over | F.col("done"), F.col("low")).otherwise(F.col("lam")),
                               "high": F.when(over & ~F.col("done"), F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        middle = (F.col("low") + F.col("high")) / 2
        step = F.when((F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        near = F.abs(F.col("got") - F.col("target")) <= F.greatest(F.lit(0.5), 1e-6 * F.col("target"))
        ended = F.col("done") | near | (F.col("high") - F.col("low") < 1e-12)
        state = stage(now.select("source", "target", "mean", F.when(ended, F.col("lam")).otherwise(step).alias("lam"), "low", "high",
                                 ended.alias("done")), "dual")
    return state


def differences(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Per size of one source, how many documents take one copy more (or less, if negative), so that its words come nearest to the target.

    Columns: source, size, gap (words missing), more and less (documents that can take or give a copy).
    """
    pdf = pdf.sort_values("size", ascending=False)
    size, gap = pdf["size"].to_numpy(np.int64), float(pdf["gap"].iloc[0])
    left, sign = abs(gap), 1 if gap > 0 else -1
    change = np.zeros(len(size), np.int64)
    for k, most in enumerate(pdf["more" if gap > 0 else "less"].to_numpy(np.int64)):
        change[k] = sign * min(most, int(left // size[k]))
        left -= abs(int(change[k])) * int(size[k])
    more, less = pdf["more"].to_numpy(np.int64) - change, pdf["less"].to_numpy(np.int64) + change
    # one document for another, or one alone: what changes by nearly the rest
    rest = sign * left
    take, give = np.append(np.flatnonzero(more > 0), -1), np.append(np.flatnonzero(less > 0), -1)
    worth = lambda at: np.where(at < 0, 0, size[at])
    give = give[np.argsort(worth(give), kind="stable")]
    near = np.searchsorted(worth(give), worth(take) - rest)
    best = (abs(rest), -1, -1)
    for shift in (-1, 0):
        at = np.clip(near + shift, 0, len(give) - 1)
        miss = np.abs(rest - worth(take) + worth(give[at]))
        k = int(miss.argmin())
        best = min(best, (float(miss[k]), int(take[k]), int(give[at[k]])))
    if best[1] >= 0:
        change[best[1]] += 1
    if best[2] >= 0:
        change[best[2]] -= 1
    hit = change != 0
    return pd.DataFrame({"source": pd.Series([key[0]] * int(hit.sum()), dtype=object), "size": size[hit], "change": change[hit]})


def same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, limit: int = 2) -> DataFrame:
    """docs with size, source_size, target, copies and taken. Without a text column, ``size`` is taken as given."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    text = "text" in docs.columns
    ident, source = F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")
    known = (F.xxhash64(F.col("text").cast("string")) if text else F.col("size").cast("long")).alias("hash")
    slim = docs.select(ident, source, known, (n_words(F.col("text")) if text else F.col("size").cast("long")).alias("size"))
    items = stage(slim.groupBy("source", "doc_id", "hash", "size").agg(F.count("*").alias("k")), "items")
    sizes = stage(items.groupBy("source", "size").agg(F.sum("k").alias("n")), "size-counts")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    goal = stage(targets(sources, weights, budget, limit), "targets")
    dual = multipliers(sizes, goal, limit)
    # square root of the rows: as many blocks as rows in a block
    plan = goal.alias("g").join(dual.alias("d"), F.col("g.source").eqNullSafe(F.col("d.source"))).select(
        F.col("g.source").alias("to"), "g.source_size", "g.target", "d.mean", "d.lam",
        F.ceil(F.sqrt(F.col("g.n").cast("double")) / 8).cast("long").alias("blocks"))
    rows = items.join(plan, same("source", "to")).drop("to")
    fixed = F.when(F.col("size") > 0, F.round(rate(F.col("size"), F.col("mean"), F.col("lam"), limit) * UNIT)).otherwise(0).cast("long")
    rows = rows.withColumns({"rate": fixed * F.col("k"), "block": F.expr("pmod(xxhash64(doc_id, hash), blocks)")})

    totals = stage(rows.groupBy("source", "block").agg(F.sum("rate").alias("sum")), "blocks")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("to"), F.col("block").alias("in"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "block").orderBy(F.desc("size"), "doc_id", "hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("rate").over(inside)).join(totals, same("source", "to") & (F.col("block") == F.col("in")))
    rows = stage(rows.select("source", "doc_id", "hash", "size", "k", "source_size", "target", (F.col("before") + F.col("upto")).alias("to_here"),
                             (F.col("before") + F.col("upto") - F.col("rate")).alias("to_last")), "placed")
    # whole copies by the running sum, from the start that brings the source nearest to its target
    copies = lambda start: F.least(F.expr(f"(to_here + {start}) div {UNIT} - (to_last + {start}) div {UNIT}"), limit * F.col("k")).cast("long")
    starts = [k * UNIT // STARTS for k in range(STARTS)]
    sums = rows.groupBy("source").agg(F.first("target").alias("goal"), *[F.sum(copies(x) * F.col("size")).alias(f"_{k}") for k, x in enumerate(starts)])
    best = sums.select(F.col("source").alias("to"), F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"_{k}") - F.col("goal")).alias("off"), (F.col("goal") - F.col(f"_{k}")).alias("gap"), F.lit(x).alias("start"))
        for k, x in enumerate(starts)])).alias("best"))
    rows = rows.join(best, same("source", "to")).withColumns({"copies": F.coalesce(copies("best.start"), F.lit(0)), "gap": F.col("best.gap")}).drop("best", "to")
    rows = stage(rows.select("source", "doc_id", "hash", "size", "k", "source_size", "target", "copies", "gap"), "rounded")

    # single copies that close what is left of the gap: one row per size of a source
    can_take, can_give = F.col("copies") < limit * F.col("k"), F.col("copies") > 0
    classes = rows.where("size > 0 and abs(gap) >= 0.5").groupBy("source", "size").agg(
        F.first("gap").alias("gap"), F.count_if(can_take).alias("more"), F.count_if(can_give).alias("less"))
    change = stage(classes.groupBy("source").applyInPandas(differences, "source string, size long, change long"), "changes")
    change = change.select(F.col("source").alias("to"), F.col("size").alias("of"), "change")
    turn = Window.partitionBy("source", "size", "sign").orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash")
    met = rows.join(change, same("source", "to") & (F.col("size") == F.col("of"))).withColumn("sign", F.signum("change").cast("long"))
    met = met.where(F.when(F.col("sign") > 0, can_take).otherwise(can_give)).withColumn("turn", F.row_number().over(turn)).where("turn <= abs(change)")
    changed = met.select(F.col("source").alias("to"), F.col("doc_id").alias("of"), F.col("hash").alias("has"), "sign")
    chosen = rows.join(changed, same("source", "to") & same("doc_id", "of") & same("hash", "has"), "left").select(
        F.col("source").alias("_source"), F.col("doc_id").alias("_doc_id"), F.col("hash").alias("_hash"), F.col("size").alias("_size"),
        F.col("k").alias("_k"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        (F.col("copies") + F.coalesce("sign", F.lit(0))).alias("_copies"))
    chosen = stage(chosen, "copies")

    # whole rows meet their copies; the payload moves here only
    whole = docs.select(F.struct(*own).alias("row"), ident, source, known, F.monotonically_increasing_id().alias("at"))
    whole = whole.join(chosen, same("source", "_source") & same("doc_id", "_doc_id") & same("hash", "_hash"))
    result = ["row", "_size", "_source_size", "_target", "_copies"]
    several = S.ordered(whole.where("_k > 1"), ["source", "doc_id", "hash"], ["at"], F.expr("shiftright(at, 33)"), nth=S.position())
    several = several.withColumn("_copies", F.expr("_copies div _k") + (F.col("nth") <= F.expr("_copies % _k")).cast("long"))
    done = whole.where("_k = 1").select(*result).unionAll(several.select(*result))
    return done.select("row.*", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                       F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))
