"""Removal of repeated passages by recompression (operator 6).

A window is ``size`` consecutive words of one document. Every word is removed
that a window covers whose word sequence also starts earlier (smaller doc_id,
or earlier in the same document).

1. Recompression: each of ``ROUNDS`` rounds names the pairs of adjacent symbols
   whose left one falls into the left half of the alphabet and whose right one
   into the right half. Names are hashes of what they stand for, so all tasks
   name alike without a dictionary. Equal neighbours fall into one half and stay
   apart: a run keeps one symbol per word, because a name for a whole run would
   leave the windows inside it without a symbol of their own.
2. Equal windows hold the same symbols but for ``MARGIN`` words at either end.
   The symbol with the least hash in that interior is the anchor of the window,
   the same one wherever the window occurs. A Spark aggregate counts all
   anchors, each known by the words around it; anchors seen once rule out every
   window they stand for.
3. Windows whose anchor recurs are compared exactly, by the hash of their
   words: a task drops what repeats within it, and one more aggregate finds
   the first start of each remaining sequence.

The filter of recurring anchors has a fixed number of bits; a false hit only
sends a window to step 3. Windows are known by 64-bit hashes.

Defined results: a null or empty text has no words (hash of the empty string);
a null doc_id sorts after all others; rows that agree in doc_id and text are one
document and get the same result each; rows with one doc_id and different texts
are ordered by the checksum of the text; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.words import (COUNTS, GATHER, batch_of, by_range, hits, mix, pack_counts, part_bits, repeated_filter, slices,
                                split, windows)
from taskloom.sources.stage import stage

ROUNDS = 2
MARGIN = 2**ROUNDS - 1
LAST = np.iinfo(np.int64).max


def parse(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, first words) of the symbols after all rounds over one word sequence."""
    name, at = h, np.arange(len(h))
    for r in range(ROUNDS):
        if len(name) < 2:
            break
        half = (mix(name + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        # left half then right half; such pairs never overlap
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~half[:-1] & half[1:]
        second = np.concatenate([[False], pair[:-1]])
        merged = name.copy()
        with np.errstate(over="ignore"):
            merged[pair] = mix(name[pair] * np.uint64(0x9E3779B97F4A7C15) + name[1:][pair[:-1]] + np.uint64(r))
        name, at = merged[~second], at[~second]
    return name, at


def anchors(h: np.ndarray, size: int) -> np.ndarray:
    """Position of the anchor of the window that begins at each word."""
    n = len(h) - size + 1
    name, at = parse(h)
    none = np.iinfo(np.uint64).max
    rank, length = np.full(len(h), none, np.uint64), np.zeros(len(h), np.int8)
    rank[at] = mix(name)
    length[at] = np.append(at[1:], len(h)) - at
    best, place = np.full(n, none, np.uint64), np.zeros(n, np.int32)
    for off in range(MARGIN, size - MARGIN):
        r = rank[off:off + n]
        better = r < best
        if off > size - MARGIN - 2**ROUNDS:
            better &= length[off:off + n] <= size - MARGIN - off
        np.copyto(best, r, where=better)
        place[better] = off
    return place + np.arange(n)


def inside(w, size: int) -> tuple[np.ndarray, ...]:
    """(row, first word, place of the anchor, key of the anchor) of every window that lies within one text of a slice.

    The words of all texts are parsed in one go: the interior of a window does
    not depend on what stands around it.
    """
    if len(w.hash) < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    whole = np.flatnonzero(row[:len(row) - size + 1] == row[size - 1:])
    place = anchors(w.hash, size)[whole]
    context = windows(w.hash, 2 * MARGIN + 1)
    return row[whole], whole, place, context[place - MARGIN]


def _row_keys(part) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([LAST if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)
    sums = np.array([zlib.crc32((t or "").encode()) for t in part.column("text").to_pylist()], np.int64)
    return ids, sums


FOUND = "part int, hashes binary, docs binary, sums binary, places binary, old_docs binary, old_sums binary, old_places binary"


def repeats(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, crc, starts binary): windows whose word sequence starts earlier, as packed 32-bit word positions."""
    bits = part_bits(docs.sparkSession)

    def anchor_keys(batches):
        for batch in batches:
            for part in slices(batch):
                _, _, place, key = inside(split(part.column("text")), size)
                if len(key):
                    # neighbouring windows share an anchor, which counts once for each place
                    yield key[np.concatenate([[True], place[1:] != place[:-1]])]

    def count(batches):
        yield from pack_counts(anchor_keys(batches), bits)

    again = repeated_filter(docs.select("text").mapInArrow(count, COUNTS), 2, bits)

    def reveal(batches):
        seen = again.value
        held, total = [], 0

        def flush():
            h, d, s, p = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((p, s, d, h))
            h, d, s, p = h[order], d[order], s[order], p[order]
            # rows that agree in all are one document read twice
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
            h, d, s, p = h[fresh], d[fresh], s[fresh], p[fresh]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            rows, old = [], ~first
            for k, i in by_range(h, bits):
                f, o = first[i], old[i]
                rows.append((k, h[i][f].tobytes(), d[i][f].tobytes(), s[i][f].astype(np.uint32).tobytes(), p[i][f].astype(np.int32).tobytes(),
                             d[i][o].tobytes(), s[i][o].astype(np.uint32).tobytes(), p[i][o].astype(np.int32).tobytes()))
            return batch_of(rows, FOUND)

        for batch in batches:
            for part in slices(batch):
                w = split(part.column("text"))
                row, start, _, key = inside(w, size)
                found = hits(seen, key)
                if not found.any():
                    continue
                row, start = row[found], start[found]
                ids, sums = _row_keys(part)
                held.append((windows(w.hash, size)[start], ids[row], sums[row], start - w.first[row]))
                total += len(row)
                if total >= GATHER // 2:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    def first_of(key, pdf):
        h, d, s, p = (np.concatenate([np.frombuffer(b, t) for b in pdf[c]])
                      for c, t in (("hashes", np.uint64), ("docs", np.int64), ("sums", np.uint32), ("places", np.int32)))
        order = np.lexsort((p, s, d, h))
        h, d, s, p = h[order], d[order], s[order], p[order]
        same = np.concatenate([[False], h[1:] == h[:-1]])
        if len(h):
            lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
            same &= (d != d[lead]) | (s != s[lead]) | (p != p[lead])
        old = [np.concatenate([np.frombuffer(b, t) for b in pdf[c]])
               for c, t in (("old_docs", np.int64), ("old_sums", np.uint32), ("old_places", np.int32))]
        d, s, p = (np.concatenate([x[same], y]) for x, y in zip((d, s, p), old))
        order = np.lexsort((s, d))
        d, s, p = d[order], s[order], p[order]
        cut = np.flatnonzero((d[1:] != d[:-1]) | (s[1:] != s[:-1])) + 1
        ends = list(zip([0, *cut], [*cut, len(d)])) if len(d) else []
        return pd.DataFrame([(int(d[a]), int(s[a]), p[a:b].tobytes()) for a, b in ends], columns=["key_id", "key_crc", "starts"])

    found = docs.select("doc_id", "text").mapInArrow(reveal, FOUND)
    return found.groupBy("part").applyInPandas(first_of, "key_id long, key_crc long, starts binary")


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: every document without the words of repeated windows."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = stage(repeats(docs, size), "repeats").groupBy("key_id", "key_crc").agg(F.collect_list("starts").alias("starts"))
    # a document is a row key, and its starts are at most as many as its words
    keyed = docs.withColumn("key_id", F.coalesce("doc_id", F.lit(int(LAST)))).withColumn(
        "key_crc", F.crc32(F.coalesce("text", F.lit(""))))
    both = keyed.join(found, ["key_id", "key_crc"], "left").select("doc_id", "text", "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_text string"

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                w = split(part.column("text"))
                ids, starts = part.column("doc_id").to_pylist(), part.column("starts").to_pylist()
                data, rows = w.data.tobytes(), []
                for row, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
                    gone = np.zeros(b - a + 1, np.int64)
                    for blob in starts[row] or ():
                        p = np.frombuffer(blob, np.int32)
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + size, -1)
                    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                    text = b" ".join(data[i:j] for i, j in zip(w.start[kept].tolist(), w.end[kept].tolist()))
                    rows.append((ids[row], int(b - a), int(b - a - len(kept)), text.decode()))
                yield batch_of(rows, schema)

    return both.mapInArrow(cut, schema)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
