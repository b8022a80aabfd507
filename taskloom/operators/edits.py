"""Edit lineage: which edit rewrote text that an earlier edit placed.

The lineage is a set of equi-joins. A Write replaces the whole file, so text
placed before it meets no edit after it: only edits of one era, from one Write
to the next, are compared. In an era of little text each new text meets each
later old text in one row, where the edits stand already if one piece of the
file holds the era. A longer era (a file that is never written anew) is
reduced to distinct texts; two texts become a candidate pair only when they
share a line that is rare for both, or the rarest anchor (a gram that a
contained text must share with its container) of one. The life of a piece of
text is an as-of scan for the first later edit that overwrites it. Nothing
compares all edits of a file with each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import classify as C
from taskloom.functions import patterns as P
from taskloom.functions import text as T
from taskloom.functions.numbers import ratio0
from taskloom.operators import scan as S
from taskloom.sources.stage import discard
from taskloom.sources.stage import stage as write_stage

MIN_TEXT = 20
FILE = ["session_id", "file_path"]
ERA = [*FILE, "era"]
#: Edits times characters up to which the texts of a group meet each other directly.
DIRECT = 1 << 28
#: Message indexes of a piece of a file. A larger piece holds more eras whole, a smaller one cuts a long file more finely.
BLOCK = 1 << 14

# (gram length, window): two texts that share a substring of gram + window - 1
# characters share an anchor of that level. A contained text uses the level of
# its length, a container offers every level.
LEVELS = [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (20, 12, 9), (64, 32, 33)]
LONG_LEVELS = LEVELS[4:]


_BASE = 1099511628211  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _window_min(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every window in linear time: running minima from both ends of blocks."""
    n, pad = len(values), -len(values) % window
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - window + 1], ahead[window - 1: n])


def _anchors(text: str, gram: int, window: int) -> np.ndarray:
    """Smallest gram hash of every window (winnowing), distinct.

    Gram hashes are differences of prefix sums of a polynomial, brought to
    position 0 by the inverse power.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - gram + 1
    if n < window:
        return np.empty(0, dtype=np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(codes) - 1))])
    hashes = (sums[gram:] - sums[:n]) * _powers(_INVERSE, n - 1)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(32)
    if window > 1:
        hashes = _window_min(hashes, window)
        hashes = hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]
    return np.unique(hashes).view(np.int64)


def anchors(text: Column, asked: Column, levels) -> Column:
    """Anchors of a text for every level named in the bit mask ``asked``; empty for the others."""
    @F.pandas_udf("array<array<long>>")
    def winnow(texts: pd.Series, masks: pd.Series) -> pd.Series:
        none = np.empty(0, dtype=np.int64)
        return pd.Series([[_anchors(t, gram, window) if m >> i & 1 else none for i, (_, gram, window) in enumerate(levels)]
                          for t, m in zip(texts, masks)])

    return winnow(text, asked)


def _level(length: Column, levels) -> Column:
    rule = F.lit(None).cast("int")
    for i, (least, _g, _w) in enumerate(levels):
        rule = F.when(length >= least, i).otherwise(rule)
    return rule


def roles(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct text: ``keys, id, text, is_new, is_old``. Both inputs hold ``keys, id, text``."""
    both = new.select(*keys, "id", "text", F.lit(True).alias("is_new"), F.lit(False).alias("is_old")).unionByName(
        old.select(*keys, "id", "text", F.lit(False).alias("is_new"), F.lit(True).alias("is_old")))
    return both.groupBy(*keys, "id").agg(F.any_value("text").alias("text"), F.bool_or("is_new").alias("is_new"), F.bool_or("is_old").alias("is_old"))


def with_anchors(texts: DataFrame, keys: list[str], levels=LONG_LEVELS) -> DataFrame:
    """texts with ``level`` and ``grams``; a group offers the levels that its own texts ask for."""
    sized = texts.withColumn("level", _level(F.length("text"), levels))
    asked = sized.where("level is not null").groupBy(*keys).agg(F.bit_or(F.expr("1 << level")).alias("_asked"))
    met = S.join_keys(sized, asked, keys, "left")
    return met.withColumn("grams", anchors(F.col("text"), F.coalesce("_asked", F.lit(0)), levels)).drop("_asked")


def contained_pairs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, small_id, large_id) of different texts where the first occurs inside the second and one is new, one old.

    ``texts`` comes from ``roles`` and ``with_anchors`` and should be a stage. A
    text that contains another offers each anchor of it, so the small text looks
    up only the one that fewest texts offer: a licence or an import block that
    all files share is never the meeting place of a text that has anything of
    its own. Keys, level and anchor meet in one 64-bit hash; a chance meeting
    does not survive the comparison of the texts, which are fetched for the
    remaining pairs alone.
    """
    each = texts.select(*keys, "id", "is_new", "is_old", "level", F.posexplode("grams").alias("at", "anchor"))
    each = each.select(*keys, "id", "is_new", "is_old", "level", "at", F.explode("anchor").alias("anchor"))
    offer = each.select(*keys, "id", "is_new", "is_old", (F.col("at") == F.col("level")).alias("own"), F.xxhash64("at", "anchor", *keys).alias("meet"))
    offered = offer.groupBy("meet").agg(F.count(F.lit(1)).alias("times"))
    # a text offers its own anchors too, so one that is offered once has no container
    probe = offer.where("own").join(offered, "meet").groupBy(*keys, "id").agg(
        F.min(F.struct("times", "meet")).alias("rare"), F.any_value("is_new").alias("small_new"), F.any_value("is_old").alias("small_old"))
    probe = probe.where("rare.times > 1").select(F.struct(*keys).alias("k"), F.col("id").alias("small_id"), "small_new", "small_old", F.col("rare.meet").alias("meet"))
    pairs = probe.join(offer.withColumnRenamed("id", "large_id"), "meet").where(
        "small_id <> large_id and (small_new and is_old or small_old and is_new)").where(F.col("k") == F.struct(*keys))
    pairs = pairs.select(*keys, "small_id", "large_id").distinct()
    s = texts.select(*keys, F.col("id").alias("small_id"), F.col("text").alias("_small"))
    g = texts.select(*keys, F.col("id").alias("large_id"), F.col("text").alias("_large"))
    return (
        S.join_keys(S.join_keys(pairs, s, [*keys, "small_id"]), g, [*keys, "large_id"])
        .where(F.contains("_large", F.col("_small")))
        .select(*keys, "small_id", "large_id")
    )


def related_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, new_id, old_id, fwd, bwd): ``fwd`` if the new text occurs in the old one, ``bwd`` if the old one in the new."""
    found = contained_pairs(texts, keys)
    role = texts.select(*keys, "id", "is_new", "is_old")
    small = S.join_keys(found, role.withColumnRenamed("id", "small_id").withColumnsRenamed({"is_new": "small_new", "is_old": "small_old"}), [*keys, "small_id"])
    both = S.join_keys(small, role.withColumnRenamed("id", "large_id"), [*keys, "large_id"])
    def way(new: str, old: str, forward: int, usable: Column) -> DataFrame:
        return both.where(usable).select(*keys, F.col(new).alias("new_id"), F.col(old).alias("old_id"),
                                         F.lit(forward).alias("fwd"), F.lit(1 - forward).alias("bwd"))
    return way("small_id", "large_id", 1, F.col("small_new") & F.col("is_old")).unionByName(
        way("large_id", "small_id", 0, F.col("is_new") & F.col("small_old")))


def shared_lines(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, new_id, old_id, shared) of all pairs with Jaccard above 0.3 or more than half of the old lines shared.

    Set similarity join with a prefix filter. Lines are ordered by how many
    texts of the group have them, rare ones first. More than half of the old
    lines shared means that one of its rarest half is; a Jaccard above 0.3 means
    that over 3/13 of both sizes together are shared, so the rarest shared line
    stands early in both. Lines that are common everywhere thus bring texts
    together only if the texts consist of little else. The sets are compared as
    arrays of line hashes.
    """
    sets = texts.where(F.size("lines") > 0).select(F.struct(*keys).alias("k"), "id", "is_new", "is_old", F.size("lines").alias("n"), "lines")
    each = sets.select("k", "id", "is_new", "is_old", "n", F.explode("lines").alias("line"))
    times = each.groupBy("k", "line").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    known = each.join(times, ["k", "line"]).groupBy("k", "id", "is_new", "is_old", "n").agg(
        F.sort_array(F.collect_list(F.struct("times", "line"))).alias("known"))
    # lines of no other text come first in the order of a text and bring nobody together
    placed = known.withColumn("alone", F.col("n") - F.size("known")).select(
        "k", "id", "is_new", "is_old", "n", "alone", F.posexplode("known").alias("at", "line")).select(
        "k", "id", "is_new", "is_old", "n", "line.line", (F.col("alone") + F.col("at")).alias("at"))
    half = placed.where("is_old and at < n - n div 2").select("k", "line", F.col("id").alias("old_id"))
    met = half.join(placed.where("is_new").select("k", "line", F.col("id").alias("new_id")), ["k", "line"])

    # both sets have over 3/13 of their sizes together in common; sizes meet in bands of half an octave
    band = lambda n: F.floor(2 * F.log2(n)).cast("int")
    sized = placed.withColumns({"own": band(F.col("n")), "other": F.explode(F.sequence(
        F.greatest(F.lit(0), band(F.col("n") * 0.3)), band(F.col("n") / 0.3)))})
    least = F.greatest(F.ceil(F.pow(F.lit(2.0), F.col("other") / 2)), F.lit(1))
    rare = sized.where(F.col("at") + F.floor(3 * (F.col("n") + least) / 13) < F.col("n"))
    def side(role: str, name: str, own: str, other: str) -> DataFrame:
        return rare.where(role).select("k", "line", F.col("own").alias(own), F.col("other").alias(other), F.col("id").alias(name))
    met = met.unionByName(side("is_old", "old_id", "o", "n").join(side("is_new", "new_id", "n", "o"), ["k", "line", "o", "n"]).select("k", "line", "old_id", "new_id"))
    pairs = met.where("new_id <> old_id").select("k", "new_id", "old_id").distinct()
    def lines_of(name: str) -> DataFrame:
        return sets.select("k", F.col("id").alias(f"{name}_id"), F.col("lines").alias(f"{name}_lines"))
    both = pairs.join(lines_of("new"), ["k", "new_id"]).join(lines_of("old"), ["k", "old_id"])
    return both.select("k.*", "new_id", "old_id", F.size(F.array_intersect("new_lines", "old_lines")).cast("long").alias("shared"))


def plain_lines(text: Column) -> Column:
    """Distinct stripped lines of more than 15 characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: T.stripped(x))
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) > 15))


def overlap_tier(new_len, old_len, new_in_old, old_in_new, shared, new_lines, old_lines) -> tuple[Column, Column]:
    """C17: (tier, ratio) of two different texts from their sizes and relations."""
    forward = new_in_old & (new_len >= 40) & (new_len / old_len >= 0.3)
    backward = old_in_new & (old_len >= 40) & (old_len / new_len >= 0.3)
    jaccard = F.try_divide(shared, new_lines + old_lines - shared)
    coverage = F.try_divide(shared, old_lines)
    by_line = (shared > 0) & ((jaccard > 0.3) | (coverage > 0.5))
    tier = F.when(forward | backward, "containment").when(by_line, "line_overlap")
    ratio = (
        F.when(forward, new_len / old_len).when(backward, old_len / new_len)
        .when(by_line, F.greatest(jaccard, coverage))
    )
    return tier, ratio


def heavy_groups(edits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Groups in which a comparison of every new with every old text would exceed ``limit``; ``edits`` holds ``chars``."""
    return edits.groupBy(*keys).agg((F.count(F.lit(1)) * F.sum("chars")).alias("_load")).where(F.col("_load") > limit).select(*keys)


def later_pairs(edits: DataFrame, keys: list[str], adds: Column, probes: Column, *more: str) -> DataFrame:
    """Every new text of a group beside every old text of a later edit: ``keys``, ``seq`` of the later, ``new_*`` and ``old_*`` of id, text and ``more``."""
    def side(name: str, usable: Column) -> DataFrame:
        return edits.where(usable).select(
            F.struct(*keys).alias("_key"), F.col("seq").alias(f"_{name}_seq"), F.col(f"{name}_id"),
            F.col(f"{name}_string").alias(f"{name}_text"), *[F.col(f"{name}_{c}") for c in more])
    met = side("new", adds).join(side("old", probes), "_key").where("_new_seq < _old_seq").withColumnRenamed("_old_seq", "seq")
    return met.select("_key.*", "seq", *[f"{name}_{c}" for name in ("new", "old") for c in ("id", "text", *more)])


def line_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(plain_lines(text), lambda x: F.xxhash64(x)))


#: What the lineage keeps of an edit once its texts are compared.
SLIM = ["seq", "msg_index", "task_id", "new_id", "old_id", "adds", "probes", "clears"]


def near_relations(edits: DataFrame, place: list[str] = ERA) -> DataFrame:
    """C17 in eras of little text: each new text beside each old text of a later edit, compared where they meet.

    The edits of an era are one row, and each edit comes back as the pair with
    itself: ``ERA, edit, rel``, one of both null. With the columns of ``PIECE``
    in ``place``, eras that a piece holds whole are compared where it stands.
    """
    sent = edits.select(*place, *SLIM, F.when(F.col("adds"), F.col("new_string")).alias("new"), F.when(F.col("probes"), F.col("old_string")).alias("old"))
    # code points are counted once for each text, not once for each pair
    each = F.struct(*SLIM, *[c for x in ("new", "old") for c in (x, F.length(x).alias(f"{x}_len"), line_hashes(F.col(x)).alias(f"{x}_set"))])
    eras = sent.groupBy(*place).agg(F.collect_list(each).alias("all"))
    met = eras.select(*ERA, "all", F.posexplode("all").alias("i", "a")).select(*ERA, "i", "a", F.posexplode("all").alias("j", "b"))
    met = met.where("i = j or a.seq < b.seq and a.adds and b.probes")
    pair = F.col("i") != F.col("j")
    new_len, old_len = F.col("a.new_len"), F.col("b.old_len")
    facts = F.struct(
        new_len.alias("new_len"), old_len.alias("old_len"), F.size("a.new_set").alias("new_lines"), F.size("b.old_set").alias("old_lines"),
        ((new_len <= old_len) & F.contains("b.old", "a.new")).cast("int").alias("fwd"),
        ((old_len <= new_len) & F.contains("a.new", "b.old")).cast("int").alias("bwd"),
        F.size(F.array_intersect("a.new_set", "b.old_set")).cast("long").alias("shared"))
    # exploded, the facts are values; as expressions they would be computed anew wherever tier and ratio name them
    sized = met.select(
        *ERA, F.when(~pair, F.struct(*[f"a.{c}" for c in SLIM])).alias("edit"), F.when(pair, F.col("a.new_id")).alias("new_id"),
        F.col("b.old_id").alias("old_id"), F.explode(F.array(F.when(pair, facts))).alias("fact")).select(*ERA, "edit", "new_id", "old_id", "fact.*")
    return tiered(sized, "edit").select(*ERA, "edit", F.when(F.col("edit").isNull(), F.struct(*RELATION)).alias("rel"))


def far_relations(edits: DataFrame, keep) -> DataFrame:
    """C17 in eras of much text: distinct texts meet over rare lines and anchors."""
    new = edits.where("adds").select(*ERA, F.col("new_id").alias("id"), F.col("new_string").alias("text"))
    old = edits.where("probes").select(*ERA, F.col("old_id").alias("id"), F.col("old_string").alias("text"))
    texts = roles(new, old, ERA).withColumns({"length": F.length("text"), "lines": line_hashes(F.col("text"))})
    texts = keep(with_anchors(texts, ERA), "texts")
    none = F.lit(0).cast("long")
    pairs = (
        shared_lines(texts, ERA).withColumns({"fwd": F.lit(0), "bwd": F.lit(0)})
        .unionByName(related_texts(texts, ERA).withColumn("shared", none))
        .groupBy(*ERA, "new_id", "old_id")
        .agg(F.max("shared").alias("shared"), F.max("fwd").alias("fwd"), F.max("bwd").alias("bwd"))
    )
    def sizes(name: str) -> DataFrame:
        return texts.select(*ERA, F.col("id").alias(f"{name}_id"), F.col("length").alias(f"{name}_len"), F.size("lines").alias(f"{name}_lines"))
    sized = S.join_keys(S.join_keys(pairs, sizes("new"), [*ERA, "new_id"]), sizes("old"), [*ERA, "old_id"])
    same = texts.where("is_new and is_old").select(
        *ERA, F.col("id").alias("new_id"), F.col("id").alias("old_id"),
        F.lit("exact").alias("tier"), F.lit(1.0).alias("ratio"), F.lit(True).alias("kills"))
    return tiered(sized).unionByName(same)


RELATION = ["new_id", "old_id", "tier", "ratio", "kills"]


def tiered(sized: DataFrame, *more: str) -> DataFrame:
    """ERA, new_id, old_id, tier, ratio, kills of the pairs that are related, and all rows in which one of ``more`` is set."""
    tier, ratio = overlap_tier(
        F.col("new_len"), F.col("old_len"), F.col("fwd") == 1, F.col("bwd") == 1,
        F.col("shared"), F.col("new_lines"), F.col("old_lines"))
    same = F.col("new_id") == F.col("old_id")
    told = sized.select(
        *ERA, *more, "new_id", "old_id", F.when(same, "exact").otherwise(tier).alias("tier"),
        F.when(same, 1.0).otherwise(ratio).alias("ratio"), (F.col("fwd") == 1).alias("kills"))
    return told.where(" or ".join(["kills", "tier is not null", *[f"{c} is not null" for c in more]]))


def by_place(edits: DataFrame, limit: int = DIRECT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edits of eras of little text that one piece holds whole, of other eras of little text, and of eras of much text.

    Which is which is known from sums per piece. The first still stand in their
    pieces; at most the first and the last era of a piece are among the second.
    """
    sums = edits.groupBy(*S.PIECE, "era").agg(F.count(F.lit(1)).alias("_n"), F.sum("chars").alias("_c"))
    wide = sums.groupBy("_key", "era").agg((F.sum("_n") * F.sum("_c") > limit).alias("_much"), F.count(F.lit(1)).alias("_pieces")).where("_much or _pieces > 1")
    marks = sums.select(*S.PIECE, "era").join(wide, ["_key", "era"]).groupBy(*S.PIECE).agg(
        F.collect_set(F.when(F.col("_much"), F.col("era"))).alias("_heavy"), F.collect_set(F.when(~F.col("_much"), F.col("era"))).alias("_parted"))
    def among(name: str) -> Column:
        return F.coalesce(F.array_contains(name, F.col("era")), F.lit(False))
    marked = edits.join(marks, S.PIECE)
    return (edits.join(marks, S.PIECE, "left").where(~among("_heavy") & ~among("_parted")).drop("_heavy", "_parted"),
            marked.where(among("_parted")).drop("_heavy", "_parted"), marked.where(among("_heavy")).drop("_heavy", "_parted"))


def compared(edits: DataFrame, limit: int = DIRECT) -> DataFrame:
    """Edits and related texts in one pass over the texts: ``ERA, edit, rel, new_string, old_string``, to be a stage.

    A row is an edit without its texts, a pair of related texts (``rel``), or an
    edit of an era of much text, with its texts. ``edits`` comes from
    ``with_eras``. Only the texts of eras of little text that lie in several
    pieces are sent again, to the place of their era.
    """
    whole, parted, much = by_place(edits, limit)
    near = near_relations(whole, [*S.PIECE, *ERA]).unionByName(near_relations(parted.repartition(*ERA)))
    far = much.select(*ERA, F.struct(*SLIM).alias("edit"), "new_string", "old_string")
    return near.unionByName(far, allowMissingColumns=True)


def related(eras: DataFrame, keep) -> DataFrame:
    """All related pairs from a stage of ``compared``."""
    near = eras.where("rel is not null").select(*ERA, "rel.*").distinct()
    much = eras.where("new_string is not null or old_string is not null").select(*ERA, "edit.*", "new_string", "old_string")
    return near if much.isEmpty() else near.unionByName(far_relations(much, keep))


def text_relations(edits: DataFrame, keep=write_stage, limit: int = DIRECT) -> DataFrame:
    """C17 for every related pair of distinct (new text, old text) of an era of a file.

    Columns: session_id, file_path, era, new_id, old_id, tier, ratio, kills.
    ``kills`` marks old texts that contain the new text and therefore overwrite
    it. ``edits`` comes from ``with_eras``.
    """
    return related(keep(compared(edits, limit), "eras"), keep)


def with_eras(edits: DataFrame) -> DataFrame:
    """edits with ``era``, the place of the last Write of the file so far, ``chars``, the length of both texts, and the pieces of the scan.

    Edits that already stand in pieces (of the same keys and blocks of message
    indexes) are not sent again.
    """
    if not set(S.PIECE) <= set(edits.columns):
        edits = S.pieces(edits, FILE, F.floor(F.col("seq") / 1000000 / BLOCK))
    cut = S.along(edits, ["seq"], era=S.highest(F.when(F.col("clears"), F.col("seq"))))
    return cut.withColumn("era", F.coalesce("era", F.lit(-1))).withColumn("chars", F.coalesce(F.length("old_string"), F.lit(0)) + F.coalesce(F.length("new_string"), F.lit(0)))


def prepare(events: DataFrame) -> DataFrame:
    """Edit events in lineage form.

    Input: session_id, file_path, task_id, msg_index, pos, tool_name, old_string,
    new_string, replace_all. ``adds``: the edit places text worth tracking.
    ``probes``: its old text is compared with earlier text and overwrites it.
    ``clears``: it replaces the whole file. Pieces that the events stand in
    (``scan.pieces`` by file and blocks of ``BLOCK`` message indexes) are kept.
    """
    longest = F.greatest(F.length("old_string"), F.length("new_string"))
    active = ~F.col("replace_all") & (longest >= MIN_TEXT)
    return events.select(
        *[c for c in S.PIECE if c in events.columns], *FILE, "task_id", "msg_index", "tool_name", "old_string", "new_string", "replace_all",
        (F.col("msg_index") * 1000000 + F.col("pos")).alias("seq"),
        F.unhex(F.md5("new_string")).alias("new_id"), F.unhex(F.md5("old_string")).alias("old_id"),
        (F.length("new_string") >= MIN_TEXT).alias("adds"),
        (active & (F.col("tool_name") == "Edit") & (F.length("old_string") >= MIN_TEXT)).alias("probes"),
        (active & (F.col("tool_name") == "Write")).alias("clears"),
    )


def overlaps(edits: DataFrame, stage=None) -> DataFrame:
    """Every (earlier edit, later edit) where the later one touches live text of the earlier one.

    ``edits`` comes from ``prepare``. A piece of text lives from its edit to the
    first later edit that overwrites it; the overwriting edit still overlaps.
    """
    keep = stage or (lambda df, _name: df)
    eras = keep(compared(with_eras(edits)), "eras")
    rel = keep(related(eras, keep), "relations")
    edits = eras.where("edit is not null").select(*ERA, "edit.*")
    chunk = F.floor(F.col("seq") / 1000000 / 4096)

    placed = edits.where("adds").select(*ERA, "seq", "new_id", "msg_index", "task_id")
    killing = rel.where("kills").select(*ERA, "new_id", "old_id", "tier", "ratio")
    asking = placed.join(killing, [*ERA, "new_id"]).select(
        *ERA, "old_id", "seq", F.lit(1).alias("asks"), "new_id", "msg_index", "task_id", "tier", "ratio",
        F.lit(None).cast("struct<seq:bigint,msg_index:bigint,task_id:string>").alias("hit"))
    hits = edits.where("probes").select(
        *ERA, "old_id", "seq", F.lit(0).alias("asks"), F.lit(None).cast("string").alias("new_id"),
        "msg_index", "task_id", F.lit(None).cast("string").alias("tier"), F.lit(None).cast("double").alias("ratio"),
        F.struct("seq", "msg_index", "task_id").alias("hit"))
    first_hit = S.ordered(
        asking.unionByName(hits), [*ERA, "old_id"], ["seq", "asks"], chunk, b=S.next_after(F.col("hit"))
    ).where("asks = 1 and b is not null").drop("hit", "asks")
    first_hit = keep(first_hit, "hits")

    cleared = S.ordered(
        edits.where("adds or clears").select(*FILE, "seq", "adds", F.when(F.col("clears"), F.col("seq")).alias("c")),
        FILE, ["seq"], chunk, cleared_at=S.next_after(F.col("c")),
    ).where("adds").select(*FILE, "seq", "cleared_at")
    deaths = first_hit.groupBy(*FILE, "seq").agg(F.min("b.seq").alias("killed_at"))
    lives = placed.join(deaths, [*FILE, "seq"], "left").join(cleared, [*FILE, "seq"], "left").withColumn(
        "death", F.least("killed_at", "cleared_at"))

    out = [
        *FILE, F.col("a.msg_index").alias("edit_a_index"), F.col("b.msg_index").alias("edit_b_index"),
        F.col("a.task_id").alias("edit_a_task"), F.col("b.task_id").alias("edit_b_task"), "tier", "ratio",
    ]
    last = first_hit.where("tier is not null").join(lives.select(*FILE, "seq", "death"), [*FILE, "seq"]).where(
        F.col("b.seq") == F.col("death")
    ).withColumn("a", F.struct("msg_index", "task_id"))
    touching = rel.where("tier is not null and not kills").select(*ERA, "new_id", "old_id", "tier", "ratio")
    probing = edits.where("probes").select(
        *ERA, "old_id", F.struct("seq", "msg_index", "task_id").alias("b"))
    partial = (
        lives.join(touching, [*ERA, "new_id"]).withColumn("a", F.struct("msg_index", "task_id"))
        .join(probing, [*ERA, "old_id"])
        .where((F.col("b.seq") > F.col("seq")) & (F.col("death").isNull() | (F.col("b.seq") <= F.col("death"))))
    )
    both = last.select(*out).unionByName(partial.select(*out))
    return both.where("edit_a_index < edit_b_index")


def last_context(overlap: DataFrame, context: DataFrame, chunk_size: int = 4096) -> DataFrame:
    """Latest error and latest unhappy user message before every later edit.

    "An event between a and b" is "the last event before b comes after a", so
    one scan replaces a range join. ``context``: session_id, msg_index, kind
    (``error`` or ``unhappy``).
    """
    probes = overlap.select("session_id", F.col("edit_b_index").alias("msg_index")).distinct().select(
        "*", F.lit(0).alias("late"), F.lit(None).cast("string").alias("kind"))
    events = context.select("session_id", "msg_index", F.lit(1).alias("late"), "kind")
    def at(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("msg_index"))
    seen = S.ordered(
        probes.unionByName(events), ["session_id"], ["msg_index", "late"],
        S.index_chunk("msg_index", chunk_size),
        last_error=S.highest_before(at("error")), last_unhappy=S.highest_before(at("unhappy")),
    )
    return seen.where("late = 0").select(
        "session_id", F.col("msg_index").alias("edit_b_index"), "last_error", "last_unhappy")


def edit_context(tasks: DataFrame, errors: DataFrame) -> DataFrame:
    """Context rows for J9 from task starts and errors."""
    unhappy = tasks.where(T.on_lower(F.col("user_prompt"), lambda low: T.any_low(low, P.DISSATISFIED_BETWEEN))).select(
        "session_id", F.col("msg_index_start").alias("msg_index"), F.lit("unhappy").alias("kind"))
    return unhappy.unionByName(errors.select("session_id", "msg_index", F.lit("error").alias("kind")))


def distances(parents: DataFrame, keep) -> DataFrame:
    """Steps from every node up to its root: a stage of session_id, edit_index, depth from rows with ``parent`` (null for a root).

    Pointer jumping: each round doubles how far a node sees, so the number of
    rounds is the logarithm of the longest way. Nodes that see their root are
    done and only answer the others.
    """
    key = ["session_id", "edit_index"]
    state = keep(parents.select(*key, F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")), "jump")
    while not state.where("up is not null").isEmpty():
        seen = state.select("session_id", F.col("edit_index").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_far"))
        ahead = state.where("up is not null").join(seen, ["session_id", "up"], "left").select(
            *key, F.col("_up").alias("up"), (F.col("depth") + F.col("_far")).alias("depth"))
        done, state = state, keep(ahead.unionByName(state.where("up is null")), "jump")
        discard(done)
    return state


def chain_depths(overlap: DataFrame, stage=write_stage) -> DataFrame:
    """Longest chain of overlaps that ends at each edit.

    Every later edit follows one of the edits it overlaps, at first the nearest.
    Pointer jumping gives the length of the way this makes for all edits at
    once. Then each edit that overlaps one with a longer way follows that one
    instead; depths never fall by this, and when nothing changes every depth is
    the longest. A chain of n edits takes log n rounds; without forks there is
    one pass. Each edit is one row in every round, exact copies of an overlap
    are removed first, and no group of rows meets in one task. Rounds that
    others were made from are deleted.
    """
    edges = stage(overlap.select("session_id", F.col("edit_a_index").alias("a"),
                                 F.col("edit_b_index").alias("edit_index")).distinct(), "edges")
    key = ["session_id", "edit_index"]
    nodes = edges.select("session_id", F.col("a").alias("edit_index")).distinct()
    parents = nodes.join(edges.groupBy(*key).agg(F.max("a").alias("parent")), key, "full")
    parents = last = stage(parents, "parents")
    while True:
        depth = distances(parents, stage)
        # of all edits that b overlaps, the deepest one, then the nearest
        reached = edges.join(depth.select("session_id", F.col("edit_index").alias("a"), F.col("depth").alias("_d")), ["session_id", "a"])
        best = reached.groupBy(*key).agg(F.max(F.struct("_d", "a")).alias("best"))
        now = stage(depth.join(best, key, "left").select(*key, "depth", (F.col("best._d") + 1).alias("better"), F.col("best.a").alias("parent")), "depths")
        discard(depth, last)
        if now.where("better > depth").isEmpty():
            return now.where("depth > 0").select(*key, "depth")
        parents, last = now.select(*key, "parent"), now


def classify_overlaps(overlap: DataFrame, context: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """C18. ``depths`` (W25) is optional: without it every chain counts as short."""
    seen = overlap.join(last_context(overlap, context), ["session_id", "edit_b_index"])
    if depths is None:
        seen = seen.withColumn("depth", F.lit(1))
    else:
        before = depths.select("session_id", F.col("edit_index").alias("edit_a_index"), F.col("depth").alias("_d"))
        seen = seen.join(before, ["session_id", "edit_a_index"], "left").withColumn(
            "depth", F.coalesce("_d", F.lit(0)) + 1).drop("_d")
    a = F.col("edit_a_index")
    kind = (
        F.when(F.col("depth") > 3, "iterative_refinement")
        .when(F.col("edit_a_task") == F.col("edit_b_task"),
              F.when(F.col("last_error") > a, "error_recovery").otherwise("self_correction"))
        .when(F.col("last_unhappy") > a, "user_directed")
        .otherwise("iterative_refinement")
    )
    return seen.withColumn("classification", kind).drop("last_error", "last_unhappy")


def task_flags(calls: DataFrame, tasks: DataFrame) -> DataFrame:
    """C20 and the use of subagents per task: session_id, task_id, bash_file_mod_count, has_subagent_edits.

    ``calls`` holds session_id, task_id and the shell ``command`` of each call, ``tasks`` session_id, task_id and ``used_subagents``.
    """
    key = ["session_id", "task_id"]
    mods = calls.where(C.changes_files(F.col("command"))).groupBy(*key).agg(F.count(F.lit(1)).alias("bash_file_mod_count"))
    return tasks.select(*key, F.coalesce("used_subagents", F.lit(False)).alias("has_subagent_edits")).join(mods, key, "left").na.fill(
        0, ["bash_file_mod_count"])


def edit_metrics(edits: DataFrame, classified: DataFrame, all_events: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """A18/A19 per task. ``all_events`` (with failures) adds the failed count, ``flags`` comes from ``task_flags``."""
    base = edits.groupBy("session_id", "task_id").agg(
        F.count_if(F.col("tool_name") == "Edit").alias("edit_count"),
        F.count_if(F.col("tool_name") == "Write").alias("write_count"),
        F.count_if((F.col("tool_name") == "Edit") & F.col("replace_all")).alias("replace_all_count"),
    )
    files = edits.select("session_id", "task_id", "file_path").distinct().groupBy("session_id", "task_id").agg(
        F.count(F.lit(1)).alias("files_edited"))
    def kind(name: str) -> Column:
        return F.count_if(F.col("classification") == name)
    found = classified.groupBy("session_id", F.col("edit_b_task").alias("task_id")).agg(
        F.count(F.lit(1)).alias("overlap_count"),
        kind("self_correction").alias("self_corrections"), kind("error_recovery").alias("error_recoveries"),
        kind("user_directed").alias("user_corrections"), kind("iterative_refinement").alias("iterative_refinements"),
        F.max("depth").alias("max_chain_depth"),
    )
    key = ["session_id", "task_id"]
    out = base.join(files, key).join(found, key, "left")
    if all_events is not None:
        failed = all_events.where(~F.col("succeeded")).groupBy(*key).agg(F.count(F.lit(1)).alias("failed_edit_count"))
        out = out.join(failed, key, "left")
    else:
        out = out.withColumn("failed_edit_count", F.lit(0).cast("long"))
    counts = [c for c in found.columns if c not in key] + ["failed_edit_count"]
    if flags is not None:
        out = out.join(flags, key, "left").na.fill(False, ["has_subagent_edits"])
        counts.append("bash_file_mod_count")
    return out.na.fill(0, counts).withColumn("triage_score", triage_score())


def triage_score() -> Column:
    """A19."""
    weighted = (
        F.col("self_corrections") * 3 + F.col("error_recoveries") * 2 + F.col("user_corrections") * 5
        + F.col("max_chain_depth")
    )
    return ratio0(weighted, F.col("edit_count") + F.col("write_count"))


def edit_summary(metrics: DataFrame, classified: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, rewrite rate and counts by tier and class."""
    totals = metrics.groupBy(*keys).agg(
        F.sum("edit_count").alias("edits"), F.sum("write_count").alias("writes"),
        F.sum("overlap_count").alias("overlaps"), F.count(F.lit(1)).alias("tasks_with_edits"))
    parts = classified.groupBy(*keys).agg(
        *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in ("exact", "containment", "line_overlap")],
        *[F.count_if(F.col("classification") == c).alias(f"class_{c}")
          for c in ("self_correction", "error_recovery", "user_directed", "iterative_refinement")])
    out = totals.join(parts, keys, "left").na.fill(0)
    return out.withColumn("rewrite_rate", ratio0(F.col("overlaps"), F.col("edits") + F.col("writes")))


RATES = ["self_corrections", "error_recoveries", "user_corrections", "iterative_refinements"]


def bin_rates(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Correction rates per edit or write in every bin."""
    sums = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("edit_count").alias("edits"), F.sum("write_count").alias("writes"),
        *[F.sum(c).alias(c) for c in RATES])
    ops = F.col("edits") + F.col("writes")
    return sums.select("*", *[ratio0(F.col(c), ops).alias(f"{c[:-1] if c != 'error_recoveries' else 'error_recovery'}_rate")
                              for c in RATES])


def tercile_of(value: Column, t1: Column, t2: Column) -> Column:
    return F.when(value <= t1, "short").when(value <= t2, "medium").otherwise("long")


def corrected_far(e: DataFrame, place: list[str], keep) -> DataFrame:
    """Edits (``place``, seq, old_id) of groups of much text whose old text is related to an earlier new text, by anchors."""
    new = e.where("new_string <> ''").select(*place, F.col("new_id").alias("id"), F.col("new_string").alias("text"))
    old = e.where("old_string <> ''").select(*place, F.col("old_id").alias("id"), F.col("old_string").alias("text"))
    texts = keep(with_anchors(roles(new, old, place), place, LEVELS), "signal-texts")
    same = texts.where("is_new and is_old").select(*place, F.col("id").alias("new_id"), F.col("id").alias("old_id"))
    related = related_texts(texts, place).select(*place, "new_id", "old_id").unionByName(same)
    placed = e.where("new_string <> ''").groupBy(*place, "new_id").agg(F.min("seq").alias("placed_at"))
    earliest = S.join_keys(related, placed, [*place, "new_id"]).groupBy(*place, "old_id").agg(
        F.min("placed_at").alias("placed_at"))
    return S.join_keys(e, earliest, [*place, "old_id"]).where("placed_at < seq").select(*place, "seq", "old_id")


def edit_signals(events: DataFrame, errors: DataFrame, tasks: DataFrame, keep=write_stage, limit: int = DIRECT) -> DataFrame:
    """Per task self-corrections, error recoveries, user corrections, rewrite rate, edits per file.

    A self-correction is an edit whose old text contains, or is contained in,
    the new text of an earlier edit of the same task and file. Both texts must
    be non-empty. Groups of little text are compared in one join, texts of
    others, of any length, are found through anchors.
    """
    key = ["session_id", "task_n"]
    place = [*key, "file_path"]
    e = events.select(
        *place, "msg_index", (F.col("msg_index") * 1000000 + F.col("pos")).alias("seq"),
        "old_string", "new_string", F.md5("old_string").alias("old_id"), F.md5("new_string").alias("new_id"),
        (F.coalesce(F.length("old_string"), F.lit(0)) + F.coalesce(F.length("new_string"), F.lit(0))).alias("chars"))
    e = keep(e, "signal-edits")
    heavy = keep(heavy_groups(e, place, limit), "heavy")
    other = heavy.select(F.struct(*place).alias("_key"))
    some = not heavy.isEmpty()
    keyed = e.withColumn("_key", F.struct(*place))
    direct = keyed.join(other, "_key", "left_anti").drop("_key") if some else e
    # in a group of little text every new text stands beside the old texts of later edits
    met = later_pairs(direct, place, F.col("new_string") != "", F.col("old_string") != "")
    again = met.where(F.contains("old_text", F.col("new_text")) | F.contains("new_text", F.col("old_text"))).select(
        *place, "seq", "old_id").distinct()
    again = S.join_keys(e.select(*place, "seq", "old_id"), again.withColumn("hit", F.lit(1)), [*place, "seq", "old_id"])
    if some:
        again = again.select(*place, "seq", "old_id").unionByName(
            corrected_far(keyed.join(other, "_key", "left_semi").drop("_key"), place, keep))
    again = again.groupBy(*key).agg(F.count(F.lit(1)).alias("self_corrections"))
    e = e.drop("old_string", "new_string")

    marks = e.select(*key, "msg_index", F.lit(0).alias("late"), F.lit(None).cast("long").alias("err")).unionByName(
        errors.select(*key, "msg_index", F.lit(1).alias("late"), F.col("msg_index").alias("err")))
    near = S.ordered(marks, key, ["msg_index", "late"], S.index_chunk("msg_index"),
                     last=S.highest_before(F.col("err"))).where(
        "late = 0 and msg_index - last between 1 and 10")
    recovered = near.groupBy(*key).agg(F.count(F.lit(1)).alias("error_recoveries"))

    per_file = e.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(
        F.sum("n").alias("events"), F.max("n").alias("max_chain_depth"))
    out = tasks.select(*key, T.on_lower(
        F.coalesce("next_user_message", F.lit("")), lambda low: T.count_matching(low, P.CORRECTION_WORDS)
    ).alias("user_corrections"))
    for part in (per_file, again, recovered):
        out = out.join(part, key, "left")
    out = out.na.fill(0, ["events", "max_chain_depth", "self_corrections", "error_recoveries"])
    return out.withColumn("rewrite_rate", ratio0(F.col("self_corrections"), F.col("events"))).drop("events")
