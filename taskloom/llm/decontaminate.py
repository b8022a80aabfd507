"""Benchmark decontamination with SimHash windows (operator 2).

A window is as many consecutive words of a document as a benchmark item has
(A-Z folded). It leaks the item if the weighted Jaccard similarity of their
``n``-word shingles (a shingle weighs as often as it occurs) is ``least`` or
more. A document shorter than an item is one window of its own length.

1. Windows in which fewer than ``least`` of the shingles occur in the benchmark
   at all cannot reach the threshold; they are left out.
2. Every other window gets a 64-bit SimHash of its shingles. ``TABLES`` tables
   map the value of one byte of a fingerprint to the items whose byte is within
   two bits: any fingerprint within ``RADIUS`` bits of an item agrees that well
   in at least one byte, so no such item is missed.
3. Items within the radius are verified by the exact similarity.

The radius of 23 bits lies more than four standard deviations beyond the
expected distance (about 10) of sets at similarity 0.8.

The benchmark is the small side and is sent to the tasks, in slices of at most
``SLICE_BYTES`` of text; each slice is one pass over the documents. Documents
are not shuffled and each row is judged alone, whatever its length.

Defined results: a null or empty text leaks nothing, a null or empty item is
never leaked; items or windows of fewer than ``n`` words count as one shingle;
null and repeated ids on either side are reported as they come; equal items are
all reported; other columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.words import batch_of, slices, split, windows

RADIUS = 23
TABLES = 8
SLICE_BYTES = 16 << 20


def fingerprints(h: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the ``length`` shingles from each start: the sign of the sum of their bits."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = total[start + length] - total[start]
    return np.packbits(2 * ones > length, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """Benchmark items of one word count, with the byte tables of their fingerprints."""

    def __init__(self, ids: list, grams: list[np.ndarray]):
        self.ids, self.grams = ids, [Counter(g.tolist()) for g in grams]
        self.print = np.array([fingerprints(g, np.zeros(1, np.int64), len(g))[0] for g in grams], np.uint64)
        part = self.print.astype("<u8").view(np.uint8).reshape(-1, TABLES)
        value = np.arange(256, dtype=np.uint8)
        self.table = [np.packbits(np.bitwise_count(value[:, None] ^ part[None, :, b]) <= RADIUS // TABLES, axis=1) for b in range(TABLES)]

    def near(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) within RADIUS."""
        byte = prints.astype("<u8").view(np.uint8).reshape(-1, TABLES)
        met = self.table[0][byte[:, 0]]
        for b in range(1, TABLES):
            met = met | self.table[b][byte[:, b]]
        w, i = np.nonzero(np.unpackbits(met, axis=1, count=len(self.ids)))
        ok = np.bitwise_count(prints[w] ^ self.print[i]) <= RADIUS
        return list(zip(w[ok].tolist(), i[ok].tolist()))


def index_of(rows: list[tuple], n: int) -> dict[int, tuple[int, np.ndarray, Items]]:
    """By word count: shingle length, sorted distinct shingles, items."""
    by = {}
    for item, text in rows:
        h = split(pa.array([text], pa.string()), lower=True).hash
        if len(h):
            by.setdefault(len(h), []).append((item, windows(h, min(n, len(h)))))
    return {size: (min(n, size), np.unique(np.concatenate([g for _, g in found])), Items([i for i, _ in found], [g for _, g in found]))
            for size, found in by.items()}


def leaks(w, index, n: int, least: float) -> dict[tuple[int, object], tuple[float, int, int, int]]:
    """(row, item) -> (similarity, -first word, words, distance) of the best window, over the texts of a slice."""
    best = {}

    def verify(row: int, i: int, window: np.ndarray, items: Items, mark: np.uint64, first: int, n_words: int) -> None:
        own, item = Counter(window.tolist()), items.grams[i]
        both = sum(min(c, own[g]) for g, c in item.items() if g in own)
        similar = both / (len(window) + item.total() - both)
        if similar >= least:
            found = (similar, -first, n_words, int(np.bitwise_count(mark ^ items.print[i])))
            key = (row, items.ids[i])
            if key not in best or found > best[key]:
                best[key] = found

    row_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for k in sorted({k for k, _, _ in index.values()}):
        h = windows(w.hash, k)
        if not len(h):
            continue
        known = np.unique(np.concatenate([s for kk, s, _ in index.values() if kk == k]))
        # a coarse table rules out nearly all shingles before the search
        coarse = np.zeros(1 << 20, bool)
        coarse[(known >> np.uint64(44)).astype(np.int64)] = True
        some = np.flatnonzero(coarse[(h >> np.uint64(44)).astype(np.int64)])
        some = some[np.isin(h[some], known)]
        if not len(some):
            continue
        member = np.zeros(len(h) + 1, np.int64)
        member[some + 1] = 1
        member = np.cumsum(member)
        long = np.diff(w.first)
        for size, (kk, _, items) in index.items():
            m = size - k + 1
            if kk != k:
                continue
            # shorter documents, whole: as many shingles as the threshold needs, and as many known ones
            grams = long - k + 1
            for row in np.flatnonzero((long < size) & (long >= k) & (grams >= least * m)).tolist():
                at, own = int(w.first[row]), int(grams[row])
                if member[at + own] - member[at] >= least * m:
                    prints = fingerprints(h[at:at + own], np.zeros(1, np.int64), own)
                    for _, i in items.near(prints):
                        verify(row, i, h[at:at + own], items, prints[0], 0, int(long[row]))
            if len(h) < m:
                continue
            # only windows around a known shingle are looked at
            near = np.unique((some[:, None] - np.arange(m)[None, :]).ravel())
            near = near[(near >= 0) & (near + size <= len(w.hash))]
            near = near[(row_of[near] == row_of[near + size - 1]) & (member[near + m] - member[near] >= least * m)]
            if not len(near):
                continue
            # fingerprints over short stretches of neighbouring windows
            for part in np.split(near, np.flatnonzero(np.diff(near) > 4 * m) + 1):
                low = part[0]
                prints = fingerprints(h[low:part[-1] + m], part - low, m)
                for a, i in items.near(prints):
                    row = int(row_of[part[a]])
                    verify(row, i, h[part[a]:part[a] + m], items, prints[a], int(part[a] - w.first[row]), size)
    return best


def _slices(benchmark: DataFrame) -> list[list[tuple]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {k}")).collect()]


MATCH = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def find(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8) -> DataFrame:
    """One row per leaked (document, item): its best window."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], MATCH)
    for rows in _slices(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = index_of(sent.value, n)
            for batch in batches:
                for part in slices(batch):
                    found = leaks(split(part.column("text"), lower=True), index, n, least)
                    ids = part.column("doc_id")
                    yield batch_of([(ids[r].as_py(), item, -at, size, far, s) for (r, item), (s, at, size, far) in found.items()], MATCH)

        out = out.unionAll(docs.mapInArrow(run, MATCH))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8) -> DataFrame:
    """The documents that leak no item, row by row and without a shuffle."""
    for rows in _slices(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = index_of(sent.value, n)
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, _ in leaks(split(part.column("text"), lower=True), index, n, least)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
