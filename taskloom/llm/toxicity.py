"""Toxicity by multiple-instance learning (operator 5).

A document is a bag of sentences (ended by ``. ! ?`` or a line break). A
logistic model scores a sentence from the words it holds: each word gives
itself and its first 4 to 8 bytes as features, letters folded. A sentence without
a screened feature adds exactly nothing; of others counts what exceeds it. The score of a
document is the noisy-or of its sentences, ``1 - prod(1 - p)``, so a document is
as toxic as its worst sentences and its label teaches the sentences that explain
it. The same sentence scores then locate the offending ones.

The model is fitted on at most ``SAMPLE`` labelled documents outside the
held-out fold, in hash order of their ids. Features that lean towards toxic
documents by ``LEAN`` standard deviations are screened by one aggregate (at most
``FEATURES``, the strongest); each of ``ROUNDS`` gradient steps is a Spark job
over the staged bags that sends the weights out and one gradient per partition
back. Everything else covers all rows.

Defined results: a null or empty text has no sentence and score 0; null ids are
scored but never train, and are not held out; repeated rows are scored each;
several labels of a document count as toxic if one says so; without toxic labels
no score comes near the threshold; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.words import batch_of, by_range, hash_runs, hits, key_filter, mix, part_bits, slices, split
from taskloom.sources.stage import stage

SAMPLE = 12_000
FEATURES = 20_000
LEAN = 5.0
ROUNDS = 30
PREFIXES = (4, 5, 6, 7, 8)
#: Log odds of a sentence without any screened feature; what a sentence has beyond them counts.
BIAS = -10.0
#: Sentences whose log odds of BIAS stand for the label of a training document that nothing else explains.
LEAK = 1000
THRESHOLD = 0.3
PARTS = 8


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(row of each sentence, sentence of each word, hashes of the words by kind of feature, first and last byte of each sentence)."""
    w = split(texts, lower=True, letters=True)
    stop = np.zeros(len(w.data) + 1, np.int64)
    stop[1:] = np.cumsum((w.data == 46) | (w.data == 33) | (w.data == 63) | (w.data == 10))
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = stop[w.start]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])]) if len(row) else np.zeros(0, bool)
    runs = (w.data >= 128) | ((w.data >= 97) & (w.data <= 122))
    kinds = [w.hash]
    for k in PREFIXES:
        h = mix(hash_runs(w.data, runs, w.start, k) + np.uint64(k)) if len(w.hash) else w.hash
        kinds.append(h)
    first = np.flatnonzero(new)
    span = np.stack([w.start[first], w.end[np.append(first[1:], len(row)) - 1]], axis=1) if len(first) else np.zeros((0, 2), np.int64)
    return row[first], np.cumsum(new) - 1, kinds, span


class Lookup:
    """Numbers of the screened features."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(known >> np.uint64(44)).astype(np.int64)] = True

    def find(self, sentence: np.ndarray, kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature number) of every screened feature of every word."""
        out = []
        for h in kinds:
            some = np.flatnonzero(self.coarse[(h >> np.uint64(44)).astype(np.int64)])
            if len(some) and len(self.known):
                at = np.minimum(np.searchsorted(self.known, h[some]), len(self.known) - 1)
                ok = self.known[at] == h[some]
                out.append((sentence[some[ok]], at[ok]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def sentence_scores(weights: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    z = BIAS + np.bincount(sentence, weights[feature], minlength=n)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def excess(p: np.ndarray) -> np.ndarray:
    """What sentences add to a document: nothing at BIAS or below, so that no length makes a text toxic."""
    floor = sentence_scores(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), 1)[0]
    return np.where(p > floor * (1 + 1e-9), (p - floor) / (1 - floor), 0.0)


def noisy_or(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the bounded training sample."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = stage(chosen, "sample")
    wanted = key_filter(chosen, "doc_id")

    def pick(batches):
        for b in batches:
            ids = b.column("doc_id")
            keep = hits(wanted.value, mix(ids.fill_null(0).to_numpy().view(np.uint64))) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(keep))

    picked = docs.select("doc_id", "text").mapInArrow(pick, "doc_id long, text string").join(chosen, "doc_id")
    return stage(picked.repartition(PARTS, "doc_id"), "training")


def screen(training: DataFrame) -> np.ndarray:
    """Sorted hashes of the features that lean towards toxic documents."""
    n, hot = training.agg(F.count("*"), F.sum("toxic")).first()
    if not hot or hot == n:
        return np.zeros(0, np.uint64)
    rate, bits = hot / n, part_bits(training.sparkSession)
    schema = "part int, hash binary, docs binary, hot binary"

    def count(batches):
        for b in batches:
            for part in slices(b):
                row, sentence, kinds, _ = sentences(part.column("text"))
                if not len(row):
                    continue
                word_row = row[sentence]
                toxic = part.column("toxic").to_numpy()
                held = []
                for h in kinds:
                    order = np.lexsort((h, word_row))
                    r, x = word_row[order], h[order]
                    new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])
                    held.append((x[new], toxic[r[new]]))
                h, t = (np.concatenate(x) for x in zip(*held))
                u, where = np.unique(h, return_inverse=True)
                yield batch_of([(k, u[i].tobytes(), c[i].tobytes(), y[i].tobytes())
                                for c, y in [(np.bincount(where).astype(np.int32), np.bincount(where, t).astype(np.int32))]
                                for k, i in by_range(u, bits)], schema)

    def lean(key, pdf):
        h, docs, toxic = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("hash", np.uint64), ("docs", np.int32), ("hot", np.int32)))
        order = np.argsort(h)
        at = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        h, docs, toxic = h[order][at], np.add.reduceat(docs[order], at), np.add.reduceat(toxic[order], at)
        z = (toxic - docs * rate) / np.sqrt(docs * rate * (1 - rate))
        ok = z >= LEAN
        return pd.DataFrame({"hash": h[ok].view(np.int64), "z": z[ok]})

    found = training.select("text", "toxic").mapInArrow(count, schema).groupBy("part").applyInPandas(lean, "hash long, z double")
    best = found.orderBy(F.desc("z"), "hash").limit(FEATURES).collect()
    return np.sort(np.array([r.hash for r in best], np.int64).view(np.uint64))


BAG = "toxic int, sentences int, sentence binary, feature binary"


def _bags(batches):
    """(label, row of each sentence, sentence of each feature, feature) of a partition, batch by batch."""
    for b in batches:
        n = np.array(b.column("sentences").to_pylist(), np.int64)
        if n.sum():
            base = np.cumsum(n) - n
            s = np.concatenate([np.frombuffer(x, np.int32) + o for x, o in zip(b.column("sentence").to_pylist(), base)])
            f = np.frombuffer(b"".join(b.column("feature").to_pylist()), np.int32)
            yield np.array(b.column("toxic").to_pylist()), np.repeat(np.arange(len(n)), n), s, f


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(screened features, their weights)."""
    training = sample(docs, labels)
    known = screen(training)
    weights = np.zeros(len(known))
    if not len(known):
        return known, weights

    def bag(batches):
        lookup = Lookup(known)
        for b in batches:
            for part in slices(b):
                row, sentence, kinds, _ = sentences(part.column("text"))
                s, f = lookup.find(sentence, kinds)
                order = np.argsort(s, kind="stable")
                s, f = s[order], f[order]
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                at = np.searchsorted(s, cut)
                toxic = part.column("toxic").to_pylist()
                yield batch_of([(toxic[r], int(cut[r + 1] - cut[r]), (s[at[r]:at[r + 1]] - cut[r]).astype(np.int32).tobytes(),
                                 f[at[r]:at[r + 1]].astype(np.int32).tobytes()) for r in range(part.num_rows)], BAG)

    bags = stage(training.select("text", "toxic").mapInArrow(bag, BAG), "bags")
    sc, size = docs.sparkSession.sparkContext, len(known)
    mean, square = np.zeros(size), np.zeros(size)
    for step in range(1, ROUNDS + 1):
        sent = sc.broadcast(weights)

        def gradient(batches, sent=sent):
            total = np.zeros(size)
            for toxic, row, sentence, feature in _bags(batches):
                p = sentence_scores(sent.value, sentence, feature, len(row))
                n = np.minimum(np.bincount(row, minlength=len(toxic)), LEAK)
                whole = np.maximum(1 - np.exp(n * np.log1p(-1 / (1 + np.exp(-BIAS)))) * (1 - noisy_or(excess(p), row, len(toxic))), 1e-9)
                pull = p * np.where(toxic[row] == 1, 1 - 1 / whole[row], 1.0)
                total += np.bincount(feature, pull[sentence], minlength=size)
            yield batch_of([(total.tobytes(),)], "v binary")

        parts = bags.mapInArrow(gradient, "v binary").collect()
        g = sum(np.frombuffer(r.v, np.float64) for r in parts) + 0.01 * weights
        mean, square = 0.8 * mean + 0.2 * g, 0.95 * square + 0.05 * g * g
        weights = weights - 0.5 * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-6)
        sent.destroy()
    return known, weights


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, offending: code-point spans of sentences at or above the threshold."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>"

    def run(batches):
        known, weights = model.value
        lookup = Lookup(known)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            for part in slices(b):
                row, sentence, kinds, at = sentences(part.column("text"))
                p = excess(sentence_scores(weights, *lookup.find(sentence, kinds), len(row))) if len(row) else np.zeros(0)
                whole = noisy_or(p, row, part.num_rows) if len(row) else np.zeros(part.num_rows)
                found = [[] for _ in range(part.num_rows)]
                texts, sizes = {}, np.cumsum([0] + [len((t.as_py() or "").encode()) for t in part.column("text")]) if (p >= THRESHOLD).any() else None
                for s in np.flatnonzero(p >= THRESHOLD):
                    r = int(row[s])
                    raw = texts.setdefault(r, (part.column("text")[r].as_py() or "").encode())
                    a, z = (len(raw[:x - sizes[r]].decode(errors="ignore")) for x in at[s])
                    found[r].append({"start": a, "end": z, "score": float(p[s])})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(whole, 0.0, 1.0)), pa.array(found, span)],
                                                 names=["doc_id", "score", "offending"])

    done = docs.mapInArrow(run, schema)
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
