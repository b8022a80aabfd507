"""Language-model scoring with a hashed maximum-entropy model (operator 10).

Tokens are the words of a text (A-Z folded) and one end. Training tokens are
those of the documents whose crc32(doc_id) mod 10 is not 0.

Counts: each task counts its tokens, and one aggregate over packed hash ranges
adds them up. The vocabulary stays a table of ranges; only its ``TOP`` most
frequent words (a bounded number) are sent to the tasks, all others are looked
up by a join of ranges.

Model: a word has a cell (a, b), two numbers below ``SIDE``; the frequent
words are dealt over the cells by rank, the others by hash.
``P(word | context) = P(a | context) P(b | a, context) P(word | cell)``: two
softmax layers over hashed features (the previous word, the word before it
skipping one, and the pair of both) and, inside a cell, smoothed relative
frequencies. Training runs in ``ROUNDS`` rounds, each over the training
documents of one residue of their checksum, so every document is seen once:
tasks take AdaGrad steps in batches from the same parameters, their changes are
added up per block of parameters, weighted by tokens, and sent out again.

Scoring: numpy batches over whole texts; contexts touch only the rows of their
own features.

Defined results: a null or empty text has the end as its only token; a null id
is not held out and trains; repeated rows are scored and counted each; without
training tokens all counts are 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.words import GATHER, batch_of, by_range, mix, part_bits, slices, split
from taskloom.sources.stage import stage

SIDE = 16
TOP = 1 << 17
RANKED = 1 << 12
FIRST_BITS, SECOND_BITS = 13, 15
ROUNDS = 2
BATCH = 1 << 15
RATE = 0.15
END = np.uint64(0x1F83D9ABFB41BD6B)
BEGIN = np.uint64(0x5BE0CD19137E2179)
BLOCKS = 64


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, previous, the one before it, row) over all texts of a slice, ends included."""
    w = split(texts, lower=True)
    rows = len(w.first) - 1
    row = np.repeat(np.arange(rows), np.diff(w.first) + 1)
    tok = np.full(len(row), END)
    tok[np.arange(len(w.hash)) + np.repeat(np.arange(rows), np.diff(w.first))] = w.hash
    start = w.first[:-1] + np.arange(rows)
    one, two = np.roll(tok, 1), np.roll(tok, 2)
    one[start] = two[start] = BEGIN
    second = start + 1
    two[second[second < np.append(start[1:], len(tok))]] = BEGIN
    return tok, one, two, row


def with_fold(docs: DataFrame) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(crc, F.lit(1)).alias("crc"),
                       F.coalesce(crc % 10 == 0, F.lit(False)).alias("held_out"))


VOCABULARY = "part int, hashes binary, counts binary, types long, tokens long"


def vocabulary(train: DataFrame) -> DataFrame:
    """One row per hash range: sorted word hashes and their counts."""
    bits = part_bits(train.sparkSession)

    def count(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return batch_of([(k, h[i].tobytes(), c[i].astype(np.uint32).tobytes()) for k, i in by_range(h, bits)], "part int, hashes binary, counts binary")

        for b in batches:
            for part in slices(b):
                held.append(tokens(part.column("text"))[0])
                n += len(held[-1])
                if n >= 2 * GATHER:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def add(key, pdf):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]]).astype(np.int64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, c = h[at], np.add.reduceat(c, at)
        return pd.DataFrame([(key[0], h.tobytes(), c.tobytes(), len(h), int(c.sum()))], columns=["part", "hashes", "counts", "types", "tokens"])

    packed = train.select("text").mapInArrow(count, "part int, hashes binary, counts binary")
    return stage(packed.groupBy("part").applyInPandas(add, VOCABULARY), "vocabulary")


def frequent(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes by falling count, counts) of at most TOP words."""
    def best(batches):
        for b in batches:
            rows = []
            for x, y in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist()):
                h, c = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                some = np.argsort(-c, kind="stable")[:TOP]
                rows += zip(h[some].tolist(), c[some].tolist())
            yield batch_of(rows, "hash long, n long")

    rows = vocab.select("hashes", "counts").mapInArrow(best, "hash long, n long").orderBy(F.desc("n"), "hash").limit(TOP).toPandas()
    return rows["hash"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)


class Lookup:
    """Place of hashes in a sorted list, -1 if absent."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def cells(h: np.ndarray, ranked: Lookup) -> np.ndarray:
    rank = ranked.find(h)
    return np.where(rank >= 0, rank % (SIDE * SIDE), (h >> np.uint64(40)).astype(np.int64) % (SIDE * SIDE))


def rows_of(one: np.ndarray, two: np.ndarray, a: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Parameter rows of the three features in both layers; the second layer knows the first one's answer."""
    with np.errstate(over="ignore"):
        features = [mix(one), mix(two + np.uint64(1)), mix(one * np.uint64(3) + two * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2))]
        first = [(f >> np.uint64(64 - FIRST_BITS)).astype(np.int64) for f in features]
        inner = a.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        second = [((f + inner) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SECOND_BITS)).astype(np.int64) for f in features]
    return first, second


def softmax(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = bias + table[rows[0]]
    for r in rows[1:]:
        z += table[r]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def shapes() -> list[tuple[int, int]]:
    return [(1 << FIRST_BITS, SIDE), (1 << SECOND_BITS, SIDE), (1, SIDE), (SIDE, SIDE)]


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for n, m in shapes():
        out.append(flat[at:at + n * m].reshape(n, m))
        at += n * m
    return out


def learn(flat: np.ndarray, square: np.ndarray, tok, one, two, ranked: Lookup) -> None:
    """One AdaGrad step in place."""
    first, second, bias, inner = unpack(flat)
    cell = cells(tok, ranked)
    a, b = cell // SIDE, cell % SIDE
    at1, at2 = rows_of(one, two, a)
    lane = np.arange(SIDE)
    grads = []
    here = np.arange(len(tok))
    p = softmax(first, bias, at1)
    p[here, a] -= 1
    q = softmax(second, inner[a], at2)
    q[here, b] -= 1
    for table, rows, d in ((first, at1, p), (second, at2, q)):
        g = np.zeros(table.size)
        flat_d = d.ravel()
        for r in rows:
            g += np.bincount((r[:, None] * SIDE + lane).ravel(), flat_d, minlength=table.size)
        grads.append(g)
    grads.append(p.sum(0))
    grads.append(np.bincount((a[:, None] * SIDE + lane).ravel(), q.ravel(), minlength=SIDE * SIDE))
    g = np.concatenate(grads).astype(np.float32)
    square += g * g
    flat -= RATE * g / (np.sqrt(square) + 1e-3)


def train_model(train: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """Parameters after ROUNDS rounds."""
    spark = train.sparkSession
    size = sum(n * m for n, m in shapes())
    flat, square = np.zeros(size, np.float32), np.full(size, 0.1, np.float32)
    step = -(-size // BLOCKS)
    # a task sends its changes once, so tasks are no more than twice the cores
    tasks = 2 * spark.sparkContext.defaultParallelism
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast((flat, square, hashes[:RANKED]))

        def work(batches, sent=sent):
            start, scale, ranked = sent.value[0], sent.value[1], Lookup(sent.value[2])
            mine, sq, seen = start.copy(), scale.copy(), 0
            for b in batches:
                for part in slices(b):
                    tok, one, two, _ = tokens(part.column("text"))
                    for i in range(0, len(tok), BATCH):
                        s = slice(i, i + BATCH)
                        learn(mine, sq, tok[s], one[s], two[s], ranked)
                    seen += len(tok)
            if seen:
                d, e = (mine - start) * np.float32(seen), (sq - scale) * np.float32(seen)
                key = TaskContext.get().partitionId() % 64
                yield batch_of([(k, key, seen, d[k * step:(k + 1) * step].tobytes(), e[k * step:(k + 1) * step].tobytes()) for k in range(BLOCKS)], schema)

        def add(keys, pdf):
            d, e = (np.sum([np.frombuffer(x, np.float32) for x in pdf[c]], axis=0, dtype=np.float32) for c in ("change", "square"))
            return pd.DataFrame([(keys[0], 0 if len(keys) == 1 else keys[1], int(pdf["seen"].sum()), d.tobytes(), e.tobytes())],
                                columns=["block", "salt", "seen", "change", "square"])

        schema = "block int, salt int, seen long, change binary, square binary"
        part = train.where(F.expr(f"(crc div 10) % {ROUNDS} = {r}")).select("text").coalesce(tasks)
        sums = part.mapInArrow(work, schema).groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(
            lambda keys, pdf: add(keys, pdf.sort_values("salt")), schema)
        flat, square = flat.copy(), square.copy()
        for row in sums.toLocalIterator():
            s = slice(row.block * step, (row.block + 1) * step)
            flat[s] += np.frombuffer(row.change, np.float32) / row.seen
            square[s] += np.frombuffer(row.square, np.float32) / row.seen
        sent.destroy()
    return flat


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    docs = with_fold(docs)
    train = docs.where("not held_out")
    vocab = vocabulary(train)
    types, total = vocab.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    hashes, counts = frequent(vocab)
    flat = train_model(train, hashes)

    known = spark.sparkContext.broadcast((hashes, counts))
    sizes = cell_sizes(vocab, known)
    model = spark.sparkContext.broadcast((flat, np.log10(sizes[0] + 0.1 * (sizes[1] + 1))))
    bits = part_bits(spark)
    schema = ("kind int, doc_id long, held_out boolean, chunk long, place int, n_tokens long, n_known long, logs double, cells double, "
              "part int, hashes binary, places binary")

    def measure(batches):
        ranked, top, value = Lookup(known.value[0][:RANKED]), Lookup(known.value[0]), np.log10(known.value[1] + 0.1)
        first, second, bias, inner = unpack(model.value[0])
        chunk, number = TaskContext.get().partitionId() << 20, 0
        held, rows, n = [], [], 0

        def flush():
            h, p = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
            order = np.argsort(h)
            h, p = h[order], p[order]
            packed = [(1, None, None, chunk + number, None, None, None, None, None, k, h[i].tobytes(), p[i].tobytes()) for k, i in by_range(h, bits)]
            return batch_of(rows + packed, schema)

        for b in batches:
            for part in slices(b):
                tok, one, two, row = tokens(part.column("text"))
                m = part.num_rows
                at = top.find(tok)
                hit = at >= 0
                logs = np.bincount(row[hit], value[at[hit]], minlength=m)
                seen = np.bincount(row[hit], minlength=m)
                held.append((tok[~hit], (row[~hit] + len(rows)).astype(np.int32)))
                fit = np.zeros(m)
                for i in range(0, len(tok), BATCH):
                    s = slice(i, i + BATCH)
                    cell = cells(tok[s], ranked)
                    a, c = cell // SIDE, cell % SIDE
                    at1, at2 = rows_of(one[s], two[s], a)
                    here = np.arange(len(cell))
                    p = np.log10(softmax(first, bias, at1)[here, a].astype(np.float64)) + np.log10(
                        softmax(second, inner[a], at2)[here, c].astype(np.float64)) - model.value[1][cell]
                    fit += np.bincount(row[s], p, minlength=m)
                length = np.bincount(row, minlength=m)
                ids, out = part.column("doc_id").to_pylist(), part.column("held_out").to_pylist()
                base = len(rows)
                rows += [(0, ids[r], out[r], chunk + number, base + r, int(length[r]), int(seen[r]), float(logs[r]), float(fit[r]), None, None, None)
                         for r in range(m)]
                n += len(tok)
                if n >= GATHER:
                    yield flush()
                    held, rows, n, number = [], [], 0, number + 1
        if rows:
            yield flush()

    measured = stage(docs.select("doc_id", "text", "held_out").mapInArrow(measure, schema), "measured")
    rest = measured.where("kind = 1").select("part", "chunk", "hashes", "places")

    def look_up(key, left, right):
        if not len(left):
            return pd.DataFrame({"chunk": [], "places": [], "logs": [], "known": []})
        out = []
        h = np.frombuffer(right["hashes"].iloc[0], np.uint64) if len(right) else np.zeros(0, np.uint64)
        c = np.frombuffer(right["counts"].iloc[0], np.int64) if len(right) else np.zeros(0, np.int64)
        table = Lookup(h)
        for chunk, x, p in zip(left["chunk"], left["hashes"], left["places"]):
            x, p = np.frombuffer(x, np.uint64), np.frombuffer(p, np.int32)
            at = table.find(x)
            n = np.where(at >= 0, c[at] if len(c) else 0, 0)
            u, back = np.unique(p, return_inverse=True)
            out.append((chunk, u.tobytes(), np.bincount(back, np.log10(n + 0.1)).tobytes(), np.bincount(back, n > 0).astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "places", "logs", "known"])

    found = rest.groupBy("part").cogroup(vocab.select("part", "hashes", "counts").groupBy("part")).applyInPandas(
        look_up, "chunk long, places binary, logs binary, known binary")

    def gather(key, pdf):
        p, v, k = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("places", np.int32), ("logs", np.float64), ("known", np.int32)))
        order = np.lexsort((v, p))
        p, v, k = p[order], v[order], k[order]
        at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        return pd.DataFrame({"chunk": key[0], "place": p[at], "more_logs": np.add.reduceat(v, at), "more_known": np.add.reduceat(k, at).astype(np.int64)})

    more = found.groupBy("chunk").applyInPandas(gather, "chunk long, place int, more_logs double, more_known long")
    done = measured.where("kind = 0").select("doc_id", "held_out", "chunk", "place", "n_tokens", "n_known", "logs", "cells").join(
        more, ["chunk", "place"], "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total + 0.1 * (types + 1)))).alias("base_score"), (logs + F.col("cells")).alias("score"))


def cell_sizes(vocab: DataFrame, known) -> tuple[np.ndarray, np.ndarray]:
    """(training tokens, words) of every cell."""
    def size(batches):
        ranked = Lookup(known.value[0][:RANKED])
        n, v = np.zeros(SIDE * SIDE, np.int64), np.zeros(SIDE * SIDE, np.int64)
        for b in batches:
            for x, y in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist()):
                cell = cells(np.frombuffer(x, np.uint64), ranked)
                n += np.bincount(cell, np.frombuffer(y, np.int64), minlength=SIDE * SIDE).astype(np.int64)
                v += np.bincount(cell, minlength=SIDE * SIDE)
        yield batch_of([(i, int(n[i]), int(v[i])) for i in range(SIDE * SIDE)], "cell int, n long, v long")

    rows = vocab.select("hashes", "counts").mapInArrow(size, "cell int, n long, v long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, v = np.zeros(SIDE * SIDE), np.zeros(SIDE * SIDE)
    for r in rows.collect():
        n[r.cell], v[r.cell] = r.n, r.v
    return n, v
