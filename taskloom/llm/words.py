"""Words, 64-bit word and shingle hashes of whole Arrow columns, and bounded bit filters.

A word is ``[^\\x20\\x09-\\x0D]+``. All functions work on the UTF-8 bytes of a
column at once; a slice of a batch holds at most ``SLICE`` bytes of text (or
one text, if it is longer), so the memory of a task does not depend on the
table. Equal words are taken as equal 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Rows gathered before a task writes them out as blobs.
GATHER = 1 << 21


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    z = z.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


@dataclass
class Words:
    data: np.ndarray    # bytes of all texts
    start: np.ndarray   # first byte of each word
    end: np.ndarray     # byte after each word
    first: np.ndarray   # index of the first word of each text, one more at the end
    hash: np.ndarray    # 64 bits per word


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most SLICE bytes of text each, but at least one row."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split(texts: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """Words of each text; a null text has none. ``lower`` folds A-Z only; ``letters`` ends words at all other ASCII signs."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    if letters:
        inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    else:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, first, hash_runs(data, inside, start))


def hash_runs(data: np.ndarray, inside: np.ndarray, start: np.ndarray, most: int | None = None) -> np.ndarray:
    """Hash of each word, or of its first ``most`` bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    low = start[0]
    span = np.diff(np.append(start, len(data)))
    power = np.ones(int(span.max()), np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = BASE
        power = np.cumprod(power)
        place = np.arange(len(data) - low) - np.repeat(start - low, span)
        value = (data[low:].astype(np.uint64) + np.uint64(1)) * power[place]
        value[~inside[low:] if most is None else ~inside[low:] | (place >= most)] = 0
        return mix(np.add.reduceat(value, start - low))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive values that begin at each position (the last k-1 positions are left out)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            total = total * BASE + h[j:j + len(total)]
    return mix(total)


def shingles(w: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct sorted k-word shingles); fewer words make one shingle, none make none."""
    every = windows(w.hash, k)
    for row in range(len(w.first) - 1):
        a, b = int(w.first[row]), int(w.first[row + 1])
        if b - a >= k:
            yield row, np.unique(every[a:b - k + 1])
        elif b > a:
            yield row, windows(w.hash[a:b], b - a) + np.uint64(b - a)
        else:
            yield row, np.zeros(0, np.uint64)


# --- rows packed by hash range -------------------------------------------------
def part_bits(spark) -> int:
    """Bits that name a hash range: about four ranges per shuffle partition, at least 256, at most 2**18."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(18, max(8, (4 * n - 1).bit_length()))


def by_range(h: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(range, slice) over sorted hashes."""
    part = (h >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut], [*cut, len(h)]):
        if b > a:
            yield int(part[a]), slice(int(a), int(b))


# --- bit filters -----------------------------------------------------------------
#: A filter has 2**FILTER_BITS bits at any data size. A hit may be false; a miss never is.
FILTER_BITS = 26


def hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds."""
    cell = h >> np.uint64(64 - FILTER_BITS)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_slice(h: np.ndarray, bits: int) -> bytes:
    """The part of a filter that belongs to one hash range, with the bits of ``h`` set."""
    marks = np.zeros(1 << (FILTER_BITS - bits), np.uint8)
    marks[((h << np.uint64(bits)) >> np.uint64(64 - FILTER_BITS + bits)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def collect_filter(slices_: DataFrame, bits: int):
    """Broadcast filter from rows (part int, blob binary); at most 2**(FILTER_BITS - 3) bytes reach the driver."""
    filled, step = np.zeros(1 << (FILTER_BITS - 3), np.uint8), 1 << (FILTER_BITS - 3 - bits)
    for r in slices_.collect():
        filled[r.part * step:(r.part + 1) * step] = np.frombuffer(bytes(r.blob), np.uint8)
    return slices_.sparkSession.sparkContext.broadcast(filled)


def repeated_filter(hashes: DataFrame, least: int, bits: int):
    """Filter of the hashes that occur ``least`` times or more.

    ``hashes`` has rows (part int, one binary, many binary, times binary) from
    ``pack_counts``. A hash is known here by its range and the next 32 bits.
    """

    def count(key, pdf):
        import pandas as pd

        one = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["one"]])
        many = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["many"]])
        times = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["times"]])
        h = np.concatenate([one, many])
        n = np.concatenate([np.ones(len(one), np.int64), times.astype(np.int64)])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        often = h[at][np.add.reduceat(n, at) >= least]
        full = (np.uint64(key[0]) << np.uint64(64 - bits)) | (often.astype(np.uint64) << np.uint64(32 - bits))
        rows = [(key[0], filter_slice(full, bits))] if len(often) else []
        return pd.DataFrame(rows, columns=["part", "blob"])

    return collect_filter(hashes.groupBy("part").applyInPandas(count, "part int, blob binary"), bits)


COUNTS = "part int, one binary, many binary, times binary"


def pack_counts(chunks: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Hashes counted within the task and packed by range, as COUNTS rows."""
    held, n = [], 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        short = (h >> np.uint64(32 - bits)).astype(np.uint32)
        rows = []
        for part, s in by_range(h, bits):
            one = c[s] == 1
            rows.append((part, short[s][one].tobytes(), short[s][~one].tobytes(), c[s][~one].astype(np.uint32).tobytes()))
        return batch_of(rows, COUNTS)

    for h in chunks:
        held.append(h)
        n += len(h)
        if n >= GATHER:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Arrow batch of Python rows, for the flat schemas used here."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def key_filter(df: DataFrame, column: str):
    """Filter of the values of a long column, found with ``mix`` of the value."""
    bits = part_bits(df.sparkSession)

    def pack(batches):
        for b in batches:
            h = np.unique(mix(b.column(0).drop_null().to_numpy().astype(np.int64).view(np.uint64)))
            if len(h):
                yield batch_of([(p, h[s].tobytes()) for p, s in by_range(h, bits)], "part int, blob binary")

    def join(key, pdf):
        import pandas as pd

        h = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["blob"]])
        return pd.DataFrame([(key[0], filter_slice(h, bits))], columns=["part", "blob"])

    packed = df.select(column).mapInArrow(pack, "part int, blob binary")
    return collect_filter(packed.groupBy("part").applyInPandas(join, "part int, blob binary"), bits)
