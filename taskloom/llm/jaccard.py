"""N-gram Jaccard join over whole texts (operator 7).

A document is its set of distinct ``n``-word shingles (A-Z folded; fewer words
make one shingle). Two documents link when ``100 * |x & y| >= percent * |x | y|``.

1. Equal sets fall into one class; only one set per class goes on.
2. A link forces a shared shingle among the first ``|x| - ceil(t |x|) + 1`` of
   each set in any order that all sets use. The order puts shingles last that
   ``COMMON`` texts or more hold, so boilerplate hardly ever brings sets together.
3. Each set is compared with the set of another component that most often leads
   its shingle groups (stars, a few rounds); components of these links remove
   nearly all comparisons of copies.
4. Groups that still hold several components are cut into tiles by size band
   and block. In a tile the bit signatures of the sets bound each overlap from
   above (the bits of two parity signatures that differ are at most the
   elements that differ). Of the pairs that can reach the threshold a tile names
   only as many as would join its components, fewer than it has; these are
   intersected exactly as sorted arrays. Links merge components, pairs that are
   none are remembered, and tiles are asked again until they name no pair.

No link is lost: step 2 is exact for any order, and step 4 ends when every pair
of a shared group that its signatures allow is connected or known to be no
link (after ``ROUNDS`` rounds a tile names all such pairs at once). A group that
names no pair is done, so a round asks only the groups that named some in the
round before. Signatures have two to four bits for a shingle, so few pairs are
named in vain. Sets and shingles are known by 64-bit hashes.

Defined results: a null or empty text has an empty set, links with nothing and
is its own component; a null ``doc_id`` takes part, and a component of such
rows only has a null id; repeated rows are equal sets; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.llm.components import components
from taskloom.llm.words import (COUNTS, batch_of, by_range, hits, key_filter, mix, pack_counts, part_bits,
                                repeated_filter, shingles, slices, split)
from taskloom.sources.stage import discard, stage

#: A shingle that so many texts hold is common: it comes last in the order.
COMMON = 32
#: Bits of a signature: two to four for a shingle, a power of two between these.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Rounds of stars before tiles, and of tiles that name few pairs.
STARS, ROUNDS = 2, 2
#: Sets of a tile's side.
BLOCK = 1024


def _set_hash(u: np.ndarray) -> np.int64:
    with np.errstate(over="ignore"):
        return (mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(u))).view(np.int64)


def _signature(u: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(u)).bit_length()))
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _bits(signatures) -> np.ndarray:
    """Signatures as rows of 64-bit words; larger ones are folded to the size of the least."""
    signatures = list(signatures)
    least = min(map(len, signatures))
    if all(len(x) == least for x in signatures):
        return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), -1)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in signatures])


def sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, node (set hash), prefix (shingles that must meet), signature."""
    bits = part_bits(docs.sparkSession)

    def every(batches):
        for batch in batches:
            for part in slices(batch):
                w = split(part.column("text"), lower=True)
                yield np.concatenate([u for _, u in shingles(w, n)] or [np.zeros(0, np.uint64)])

    def packed(batches):
        yield from pack_counts((h for h in every(batches) if len(h)), bits)

    common = repeated_filter(docs.select("text").mapInArrow(packed, COUNTS), COMMON, bits)
    schema = "doc_id long, text_hash long, n_shingles long, node long, prefix binary, signature binary"

    def build(batches):
        last = common.value
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
                rows = []
                for row, u in shingles(split(part.column("text"), lower=True), n):
                    if not len(u):
                        rows.append((ids[row], texts[row], 0, None, None, None))
                        continue
                    behind = hits(last, u)
                    need = len(u) - -(-percent * len(u) // 100) + 1
                    front = np.concatenate([u[~behind], u[behind]])[:need]
                    rows.append((ids[row], texts[row], len(u), int(_set_hash(u)), front.tobytes(), _signature(u)))
                yield batch_of(rows, schema)

    return stage(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(build, schema), "sets"), common


def postings(nodes: DataFrame, common, bits: int) -> DataFrame:
    """(shingle, node, n_shingles) of every prefix shingle that two sets or more share.

    Groups of rare shingles hold few sets and are formed from packed rows;
    common ones may be groups of any size and stay rows of their own.
    """

    def pack(batches):
        last = common.value
        held, total = [], 0

        def flush():
            tok, node, size = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(tok)
            tok, node, size = tok[order], node[order], size[order]
            often = hits(last, tok)
            t, d, s = tok[~often], node[~often], size[~often]
            yield batch_of([(p, None, None, t[i].tobytes(), d[i].tobytes(), s[i].tobytes()) for p, i in by_range(t, bits)], schema)
            if often.any():
                blank = [b""] * int(often.sum())
                rows = list(zip((tok[often] & np.uint64((1 << 30) - 1)).astype(np.int64).tolist(), tok[often].view(np.int64).tolist(),
                                node[often].tolist(), blank, blank, [x.tobytes() for x in size[often].reshape(-1, 1)]))
                yield batch_of(rows, schema)

        for batch in batches:
            nodes_, sizes = batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy()
            for i, blob in enumerate(batch.column("prefix")):
                t = np.frombuffer(blob.as_py(), np.uint64)
                held.append((t, np.full(len(t), nodes_[i]), np.full(len(t), sizes[i], np.int32)))
                total += len(t)
                if total >= 1 << 20:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    schema = "part long, shingle long, node long, tokens binary, nodes binary, sizes binary"

    def group(key, pdf):
        tok = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["tokens"]])
        node = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["nodes"]])
        size = np.concatenate([np.frombuffer(b, np.int32) for b in pdf["sizes"]])
        order = np.argsort(tok)
        tok, node, size = tok[order], node[order], size[order]
        same = tok[1:] == tok[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return pd.DataFrame({"shingle": tok[shared].view(np.int64), "node": node[shared], "n_shingles": size[shared].astype(np.int64)})

    packed = stage(nodes.select("node", "n_shingles", "prefix").mapInArrow(pack, schema), "prefixes")
    rare = packed.where("shingle is null").groupBy("part").applyInPandas(group, "shingle long, node long, n_shingles long")
    often = packed.where("shingle is not null").select("shingle", "node")
    often = often.join(nodes.select("node", "n_shingles"), "node").select("shingle", "node", "n_shingles")
    found = stage(rare.unionAll(often), "postings")
    discard(packed)
    return found


def fitting(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures leave room for the overlap that a link needs."""
    side = nodes.select("node", "n_shingles", "signature")
    both = pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b").where(fitting("n_a", "n_b", percent))

    def bound(batches):
        for batch in batches:
            rows = []
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            width = np.minimum(*(pc.binary_length(batch.column(c)).to_numpy() for c in ("s_a", "s_b")))
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x, y = (batch.column(c).take(pa.array(at)).to_pylist() for c in ("s_a", "s_b"))
                bits = _bits(x + y)
                keep = at[possible((n_a + n_b)[at], np.bitwise_count(bits[:len(at)] ^ bits[len(at):]).sum(1), percent)]
                rows += zip(batch.column("a").to_numpy()[keep].tolist(), batch.column("b").to_numpy()[keep].tolist())
            yield batch_of(rows, "a long, b long")

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(bound, "a long, b long")


def possible(total: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap can reach the threshold: it is at most half of what does not differ."""
    most = (total - differ) // 2
    return 100 * most >= percent * (total - most)


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among the pairs (a, b), by intersecting the sorted shingle arrays."""
    wanted = stage(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "wanted")
    ids = stage(nodes.select("node", "rep", "any_null").join(wanted, "node", "left_semi"), "wanted-rows")
    chosen = key_filter(ids, "rep")
    nulls = bool(ids.where("any_null").take(1))

    def read(batches):
        bits = chosen.value
        for batch in batches:
            ids_ = batch.column("doc_id")
            keep = hits(bits, mix(ids_.fill_null(0).to_numpy().view(np.uint64)))
            keep[ids_.is_null().to_numpy(zero_copy_only=False)] = nulls
            batch = batch.filter(pa.array(keep))
            for part in slices(batch):
                rows = [(int(_set_hash(u)), u.tobytes()) for _, u in shingles(split(part.column("text"), lower=True), n) if len(u)]
                yield batch_of(rows, "node long, shingles binary")

    arrays = docs.select("doc_id", "text").mapInArrow(read, "node long, shingles binary")
    arrays = stage(arrays.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "arrays")
    both = pairs.join(arrays.toDF("a", "x"), "a").join(arrays.toDF("b", "y"), "b")

    def meet(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    rows.append((a, b))
            yield batch_of(rows, "a long, b long")

    links = stage(both.mapInArrow(meet, "a long, b long"), "links")
    discard(wanted, ids, arrays)
    return links


def labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return shared.withColumn("label", F.col("node"))
    return shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def stars(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """For each set one set of another component: the one that leads most of its shingle groups."""
    named = labelled(shared, labels)
    heads = named.groupBy("shingle").agg(F.min(F.struct("label", "node")).alias("low"), F.max(F.struct("label", "node")).alias("high")).where(
        "low.label < high.label")
    met = named.join(heads, "shingle").select(F.col("node").alias("a"), F.expr("if(label = low.label, high.node, low.node)").alias("b"))
    return met.groupBy("a", "b").agg(F.count("*").alias("times")).groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))


def tiles(mixed: DataFrame, nodes: DataFrame, refuted: DataFrame | None, percent: int, every: bool) -> DataFrame:
    """(a, b, shingle): pairs of different components that a tile cannot rule out; mixed has (shingle, node, n_shingles, label).

    A tile names a forest of pairs over its components, or ``every`` pair. Pairs
    in ``refuted`` (a, b) are known to be no links.
    """
    size = mixed.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent))).cast("int")
    rows = mixed.join(size, "shingle").withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
    rows = rows.withColumn("own", band)
    # a tile (band, i, j) pairs block i of a band with block j of the same band or the next one
    low = rows.select("*", F.col("own").alias("band"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j")).select(
        "shingle", "band", F.col("block").alias("i"), "j", F.lit(0).alias("side"), "node", "n_shingles", "label")
    high = rows.select("*", F.explode(F.array("own", F.col("own") - 1)).alias("band")).select(
        "*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i")).select(
        "shingle", "band", "i", F.col("block").alias("j"), F.lit(1).alias("side"), "node", "n_shingles", "label")
    cells = low.unionAll(high).withColumn("tile", F.xxhash64("shingle", "band", "i", "j"))
    # tiles of one component are dropped while their rows are still slim
    whole = Window.partitionBy("tile")
    cells = cells.select("tile", "shingle", "side", "node", "n_shingles", "label", F.min("label").over(whole).alias("l"), F.max("label").over(whole).alias("h"),
                         F.min("side").over(whole).alias("s")).where("l < h and s = 0")
    extra = nodes.select("node", "signature")
    if refuted is None:
        extra = extra.withColumn("no", F.lit(None).cast("array<long>"))
    else:
        # a pair is kept with its greater set
        extra = extra.join(refuted.groupBy(F.col("b").alias("node")).agg(F.collect_set("a").alias("no")), "node", "left")
    cells = cells.join(extra, "node").select("tile", "shingle", "side", "node", "n_shingles", "label", "signature", "no")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, "tile").sortWithinPartitions("tile", "side")

    def compare(frames):
        rest = None
        for pdf in frames:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = rest["tile"].iloc[-1]
            done = rest[rest["tile"] != last]
            rest = rest[rest["tile"] == last]
            yield _pairs(done, percent, every)
        if rest is not None:
            yield _pairs(rest, percent, every)

    return cells.mapInPandas(compare, "a long, b long, shingle long")


def _pairs(pdf: pd.DataFrame, percent: int, every: bool) -> pd.DataFrame:
    """Pairs of the tiles in a frame: per tile a forest over its components, or all."""
    if not len(pdf):
        return pd.DataFrame(np.zeros((0, 3), np.int64), columns=["a", "b", "shingle"])
    tile, shingle, side, node, size, label, no = (pdf[c].to_numpy() for c in ("tile", "shingle", "side", "node", "n_shingles", "label", "no"))
    signatures = pdf["signature"].to_numpy()
    cut = np.flatnonzero(np.diff(tile)) + 1
    out = set()
    for a, b in zip([0, *cut], [*cut, len(tile)]):
        m = a + int(np.searchsorted(side[a:b], 1))
        if not a < m < b:
            continue
        right = slice(m, b)
        bits = _bits(signatures[a:b])
        root = label[a:b].copy()  # components of the tile, joined by the pairs it has named
        for i in range(a, m):
            ok = (root[m - a:] != root[i - a]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))
            at = np.flatnonzero(ok) + m
            if not len(at):
                continue
            differ = np.bitwise_count(bits[at - a] ^ bits[i - a]).sum(1)
            fits = possible(size[at] + size[i], differ, percent)
            at, near = at[fits], (differ / (size[at] + size[i]))[fits]
            new = ~_known(no, node, i, at)
            at, near = at[new], near[new]
            if every:
                out.update((min(node[i], x), max(node[i], x), shingle[i]) for x in node[at])
                continue
            for j in at[np.argsort(near, kind="stable")]:
                if root[j - a] != root[i - a]:
                    out.add((min(node[i], node[j]), max(node[i], node[j]), shingle[i]))
                    root[root == root[j - a]] = root[i - a]
    return pd.DataFrame(np.array(sorted(out), np.int64).reshape(-1, 3), columns=["a", "b", "shingle"])


def _known(no: np.ndarray, node: np.ndarray, i: int, at: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, at) are known to be no links."""
    mine = np.isin(node[at], no[i]) if no[i] is not None else np.zeros(len(at), bool)
    for k in np.flatnonzero([x is not None for x in no[at]]):
        mine[k] |= bool((no[at[k]] == node[i]).any())
    return mine


def linked_sets(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles and node of every row, (node, label of its component, component_id) of every set)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    whole, common = sets(docs, n, percent)
    every = stage(whole.select("doc_id", "text_hash", "n_shingles", "node"), "rows")
    unique = stage(whole.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"),
        F.first("signature").alias("signature"), F.max(F.col("doc_id").isNull()).alias("any_null")), "unique")
    discard(whole)
    shared = postings(unique, common, part_bits(docs.sparkSession))
    nodes = stage(unique.drop("prefix"), "nodes")
    discard(unique)

    links = labels = None
    for _ in range(STARS):
        pairs = stage(may_link(stars(shared, labels), nodes, percent), "stars")
        found = verify(pairs, docs, nodes, n, percent)
        discard(pairs)
        if not found.take(1):
            break
        links = found if links is None else links.unionAll(found)
        labels = stage(components(links), "labels")

    refuted = None
    for turn in range(ROUNDS + 1):
        named = labelled(shared, labels)
        several = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        mixed = stage(named.join(several.select("shingle"), "shingle", "left_semi"), "mixed")
        named = stage(tiles(mixed, nodes, refuted, percent, every=turn == ROUNDS), "tiles")
        discard(shared)
        if not named.take(1):
            break
        pairs = stage(named.select("a", "b").distinct(), "pairs")
        shared = stage(mixed.drop("label").join(named.select("shingle").distinct(), "shingle", "left_semi"), "asked-again")
        discard(mixed, named)
        found = verify(pairs, docs, nodes, n, percent)
        vain = stage(pairs.join(found, ["a", "b"], "left_anti"), "refuted")
        discard(pairs)
        refuted = vain if refuted is None else refuted.unionAll(vain)
        if found.take(1):
            links = found if links is None else links.unionAll(found)
            labels = stage(components(links), "labels")
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("label"))

    owner = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = owner.groupBy("label").agg(F.min("rep").alias("component_id"))
    owner = stage(owner.join(least, "label").select("node", "label", "component_id"), "owners")
    return every, owner


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    every, owner = linked_sets(docs, n, percent)
    return every.join(owner.drop("label"), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, single) of one row per component: the smallest id, nulls last, then the smallest text hash.

    Rows that link with nothing for want of words are all listed, once per (doc_id, text_hash);
    ``single`` marks those without an id, each of which is a component.
    """
    every, owner = linked_sets(docs, n, percent)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    # rows of one set shrink to one before they meet their component
    least = every.where("node is not null").groupBy("node").agg(F.min(row).alias("row")).join(owner, "node").groupBy("label").agg(F.min("row").alias("row"))
    empty = every.where("node is null").select("doc_id", "text_hash", F.col("doc_id").isNull().alias("single")).distinct()
    return least.select("row.doc_id", "row.text_hash", F.lit(False).alias("single")).unionAll(empty)
