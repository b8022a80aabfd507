"""Periodic runs of words by Lyndon roots (operator 13).

A run is a stretch of words with smallest period q, at least ``exponent``
periods long, that no neighbouring word extends. Every run holds Lyndon words of
length q (its roots) that are the longest Lyndon words at their places, under
one order of the words or under the opposite one.

``lyndon`` is the grouping phase of Baier's suffix sorter: groups of suffixes
are taken from the highest down; each member passes itself on to the nearest
suffix to its left that lies in a lower group, and suffixes that received equal
numbers from a group form a new group, whose prefix is longer by as many copies.
When a group is taken, its prefix is the longest Lyndon word of its members. No
suffix is ever compared and no second phase is needed.

A run of at least four periods shows as three roots of equal length in a row.
Such roots are extended by the longest common extensions of i and i + q to both
sides, compared word by word in doubling blocks. The period of a Lyndon word is
its length, so q is the smallest one.

Before grouping, a document is cut where no run can be: each three consecutive
words of a run occur three times or more in it. What remains is cut again until
nothing changes (``ROUNDS`` times at most: more cuts would only save work).
Words are compared as bytes; a task holds the words of one document at a time.

Defined results: null, empty and blank texts have no run and an empty collapsed
text; ids are not used; repeated rows get equal results; an empty table gives no
rows; all columns of the input are kept, the result is one struct column under a
free name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.columns import free_name, whole_text

ROUNDS = 8
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def lyndon(word: list[int], kinds: int) -> np.ndarray:
    """Length of the longest Lyndon word at every place of a sequence over 0 .. kinds-1."""
    n = len(word)
    out = np.zeros(n, np.int64)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, c in enumerate(word):
        members[c].append(i)
    group, size = list(word), [1] * kinds
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    # nearest[k] == k while suffix k - 1 waits; index 0 stands for "none to the left"
    nearest = list(range(n + 1))
    g = kinds - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in own:
            nearest[i + 1] = i
        out[own] = size[g]
        received: dict[int, int] = {}
        for i in own:
            k = i
            while nearest[k] != k:
                nearest[k] = nearest[nearest[k]]
                k = nearest[k]
            if k:
                received[k - 1] = received.get(k - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in received.items():
            moved.setdefault((group[j], times), []).append(j)
        # more copies of a higher prefix sort higher; what received none stays lowest
        for (old, times), to_move in sorted(moved.items(), reverse=True):
            new = len(size)
            size.append(size[old] + times * size[g])
            members.append(to_move)
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
            for j in to_move:
                group[j] = new
        g = below[g]
    return out


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix of two arrays of one length."""
    at, step = 0, 16
    while at < len(a):
        differ = a[at:at + step] != b[at:at + step]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at += step
        step *= 2
    return len(a)


def stretches(ids: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of parts in which each three consecutive words may belong to a run; the rest holds none."""
    todo = [(0, len(ids), ROUNDS)]
    while todo:
        a, b, rounds = todo.pop()
        if b - a < least:
            continue
        part = ids[a:b].astype(np.uint64)
        with np.errstate(over="ignore"):
            code = (part[:-2] * np.uint64(0x9E3779B97F4A7C15) + part[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + part[2:]
        _, place, times = np.unique(code, return_inverse=True, return_counts=True)
        often = times[place] >= 3
        live = np.zeros(b - a + 2, bool)
        live[1:-3] = often
        live[2:-2] |= often
        live[3:-1] |= often
        if live[1:-1].all() or not rounds:
            yield a, b
            continue
        edge = np.flatnonzero(live[1:] != live[:-1]).reshape(-1, 2) + a
        todo.extend((int(x), int(y), rounds - 1) for x, y in edge)


def runs_of(ids: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``exponent`` >= 4 periods, in order."""
    found = []
    for a, b in stretches(ids, least):
        names, part = np.unique(ids[a:b], return_inverse=True)
        n, kinds = b - a, len(names)
        places = []
        for order in (part, kinds - 1 - part):
            root = lyndon(order.tolist(), kinds)
            i = np.flatnonzero(np.arange(n) + 3 * root <= n)
            i = i[(root[i + root[i]] == root[i])]
            i = i[(root[i + 2 * root[i]] == root[i])]
            places.append(np.stack([root[i], i]))
        period, place = np.unique(np.concatenate(places, axis=1), axis=1)
        last = (0, 0, 0)  # period, begin and end of the newest stretch
        for q, i in zip(period.tolist(), place.tolist()):
            if q == last[0] and i + 2 * q <= last[2]:
                continue
            end = i + q + reach(part[i:n - q], part[i + q:])
            begin = i - reach(part[:i][::-1], part[q:i + q][::-1])
            last = (q, begin, end)
            if end - begin >= max(least, exponent * q):
                found.append((begin + a, end - begin, q))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def analyse(text: bytes, least: int, exponent: int) -> tuple[int, list[tuple[int, int, int]], str]:
    """(number of words, runs, text with one period of each run) of one text in UTF-8."""
    words = text.split()  # bytes split at 20 and 09 to 0D
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = runs_of(ids, least, exponent)
    kept = words
    if found:
        step = np.zeros(len(words) + 1, np.int64)
        for start, length, q in found:
            step[start + q] += 1
            step[start + length] -= 1
        kept = [w for w, n in zip(words, np.cumsum(step).tolist()) if not n]
    return len(words), found, b" ".join(kept).decode()


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, into: str = "periodic") -> DataFrame:
    """docs with a struct (n_words, runs by start and period, collapsed text) in column ``into``.

    Collapsed drops every word that some run contains after its first period.
    ``exponent`` is 4 or more: shorter repetitions need not show three roots.
    """
    if exponent < 4 or least < 6:
        raise ValueError("runs of fewer than six words or four periods are not found by this operator")

    @F.arrow_udf(RESULT)
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [analyse(t.as_buffer().to_pybytes(), least, exponent) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(found) for _, found, _ in done], dtype=np.int64)]).astype(np.int32)
            flat = np.array([run for _, found, _ in done for run in found], np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(SPAN))
            listed = pa.ListArray.from_arrays(pa.array(offsets), spans)
            yield pa.StructArray.from_arrays([pa.array([n for n, _, _ in done], pa.int64()), listed, pa.array([c for _, _, c in done], pa.string())],
                                             names=["n_words", "runs", "collapsed"])

    return docs.withColumn(free_name(docs, into), detect(whole_text()))
