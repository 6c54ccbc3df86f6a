"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are hashed byte n-grams of the lower-cased text with white space as one blank, each twice: whether a text
holds it, and whether it is dense there, once in DENSE bytes or more often. A long clean text holds most n-grams by
chance; dense ones tell what it is about. From labelled texts Spark counts, for each feature, in how many texts of
either class it occurs. The smoothed log-count ratio r scales it; features whose shares in the two classes differ by
less than min_z standard errors or by less than a factor of e are left out, which keeps a long clean text from adding
up noise. A logistic regression over the scaled presence of the rest gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import ship, written
from listingops.llm.words import WHITE, buffers_of, runs

ORDERS = (3, 4, 5)
SLOTS = 1 << 20
PIECE = 1 << 18
DENSE = 500
_BYTE = np.arange(256, dtype=np.uint32)
_BYTE[65:91] += 32
_BYTE[WHITE] = 32
_BYTE = _BYTE + np.uint32(1)


def ngram_slots(data: np.ndarray) -> np.ndarray:
    """(orders, bytes) slots of the n-grams that start at each byte; those that pass the end are filled with blanks."""
    n = len(data)
    v = np.full(n + max(ORDERS), 33, dtype=np.uint32)
    v[:n] = _BYTE[data]
    out = np.empty((len(ORDERS), n), dtype=np.uint32)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint32)
        for j in range(max(ORDERS)):
            h = h * np.uint32(0x01000193) + v[j : j + n] * np.uint32(0x85EBCA6B)
            if j + 1 in ORDERS:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39 + 2 * j)
                out[ORDERS.index(j + 1)] = x >> np.uint32(12)
    return out


def _texts(batch: pa.RecordBatch, column: int):
    """(first row, last row + 1, bytes, offsets of the rows in them, first byte whose n-grams are not counted here).

    Blocks have about PIECE bytes. A longer text comes in several pieces, each with the bytes that its last n-grams need
    of the next.
    """
    data, offsets = buffers_of(batch.column(column))
    for i, j in runs(offsets, PIECE):
        low, high = offsets[i], offsets[j]
        if high - low <= 2 * PIECE:
            yield i, j, data[low:high], offsets[i : j + 1] - low, high - low
            continue
        for at in range(low, high, PIECE):  # one long text
            part = data[at : min(high, at + PIECE + max(ORDERS) - 1)]
            yield i, j, part, np.array([0, len(part)]), PIECE


@dataclass(frozen=True)
class Model:
    slots: np.ndarray  # sorted; of dense n-grams SLOTS more
    weights: np.ndarray  # of the regression, times r
    bias: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each slot among those in use, from 1 on, and there the numbers of its two features, or -1."""
        used = np.unique(self.slots % SLOTS)
        places = np.zeros(SLOTS, dtype=np.int32)
        places[used] = np.arange(1, len(used) + 1)
        features = np.full((2, len(used) + 1), -1, dtype=np.int64)
        features[self.slots // SLOTS, places[self.slots % SLOTS]] = np.arange(len(self.slots))
        return places, features


def hits(batch: pa.RecordBatch, column: int, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number) of the features present in each text, each once, by row."""
    places, features = table
    rows, found = [], []
    for i, j, data, off, stop in _texts(batch, column):
        if not len(data):
            continue
        for order, slots in zip(ORDERS, ngram_slots(data), strict=True):
            f = places[slots]
            at = np.flatnonzero(f)
            r = np.searchsorted(off, at, side="right") - 1
            whole = (at + order <= off[r + 1]) & (at < stop)  # no n-gram of the next text's bytes
            rows.append(r[whole] + i)
            found.append(f[at[whole]])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, n = np.unique(np.concatenate(rows).astype(np.int64) << 32 | np.concatenate(found).astype(np.int64), return_counts=True)
    row, place = key >> 32, key & 0xFFFFFFFF
    dense = n * DENSE >= np.diff(buffers_of(batch.column(column))[1])[row]
    row, feature = np.concatenate((row, row[dense])), np.concatenate((features[0, place], features[1, place[dense]]))
    by = np.lexsort((feature, row))
    by = by[feature[by] >= 0]
    return row[by], feature[by]


def slots_of_rows(batch: pa.RecordBatch, column: int):
    """(row, slots with those of dense n-grams) of each text that is not empty."""
    lengths = np.diff(buffers_of(batch.column(column))[1])
    last, held = -1, []

    def done():
        slots, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        dense = np.bincount(at, np.concatenate([n for _, n in held])) * DENSE >= lengths[last]
        return last, np.concatenate((slots.astype(np.int64), slots[dense].astype(np.int64) + SLOTS))

    for i, j, data, off, stop in _texts(batch, column):
        slots = ngram_slots(data)
        for r in range(i, j):
            if r != last and held:
                yield done()
                held = []
            s, e = off[r - i], off[r - i + 1]
            own = [slots[o, s : max(s, min(stop, e - k + 1))] for o, k in enumerate(ORDERS)]
            held.append(np.unique(np.concatenate(own), return_counts=True))
            last = r
    if held:
        yield done()


def regression(rows: np.ndarray, feats: np.ndarray, r: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss over r-scaled presence, by accelerated gradient descent."""
    n, m = len(y), len(r)
    x = r[feats]
    row_norm = np.bincount(rows, x * x, n).max(initial=1.0) + 1.0
    share = max(1e-3, y.mean())
    cost = np.where(y > 0, 0.5 / share, 0.5 / max(1e-3, 1 - share))
    step = 4.0 / (row_norm * cost.max() + l2)
    w, b = np.zeros(m), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(rows, x * vw[feats], n) + vb, -40, 40)))
        g = cost * (p - y)
        nw = vw - step * (np.bincount(feats, x * g[rows], m) / n * 1.0 + l2 * vw / n)
        nb = vb - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 24_000, most_features: int = 4096, min_z: float = 3.0, l2: float = 1.0, steps: int = 300, seed: int = 3) -> Model:
    """The classifier of docs(doc_id, text) as labels(doc_id, label 0/1) marks them; null labels take no part.

    sample_rows bounds the labelled rows it is fitted on, chosen by a hash of doc_id, one for each doc_id; their ids are
    broadcast, so no text outside the sample is shuffled. most_features bounds the features, those that tell most
    first; neither they nor the counts depend on the number of tasks. The regression runs on the driver over the numbers
    of the features in the sample's texts, sample_rows lists of most_features at most, whatever the input. Without rows
    of both classes every score is the share of label 1.
    """
    spark = docs.sparkSession
    ship(spark)
    some = labels.filter(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    some = some.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x"))
    known = written(known.select("doc_id", "x.text", "x.label").repartition(8), "labelled")
    schema = pa.schema([("slot", pa.int32()), ("clean", pa.int32()), ("toxic", pa.int32())])

    def count(batches):
        seen = np.zeros((2, 2 * SLOTS), dtype=np.int32)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for r, own in slots_of_rows(batch, 0):
                seen[int(labels[r] == 1), own] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[0, at]), pa.array(seen[1, at])], schema=schema)

    n0, n1 = (known.filter(F.col("label") == k).count() for k in (0, 1))
    if not n0 or not n1:
        p = min(0.99, max(0.01, n1 / max(1, n0 + n1)))
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(p / (1 - p))))
    sums = known.select("text", "label").mapInArrow(count, "slot int, clean int, toxic int").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    c, t = F.col("c"), F.col("t")
    ratio = F.log((t + 0.5) / (n1 + 1.0)) - F.log((c + 0.5) / (n0 + 1.0))
    share = (c + t) / float(n0 + n1)
    z = (t / float(n1) - c / float(n0)) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1.0 / n1 + 1.0 / n0))
    picked = sums.select("slot", ratio.alias("r"), z.alias("z")).filter((F.abs("z") >= min_z) & (F.abs("r") >= 1.0)).orderBy(F.abs("z").desc(), "slot").limit(most_features).toPandas().sort_values("slot")
    slots, r = picked["slot"].to_numpy(np.int64), picked["r"].to_numpy(float)
    model = Model(slots, r, 0.0)
    table = model.table()

    def features(batches):
        for batch in batches:
            rows, feats = hits(batch, 0, table)
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(feats.astype(np.int32)))], names=["key", "label", "feats"])

    keyed = known.select("text", "label", F.col("doc_id").cast("string").alias("key"))
    sample = keyed.mapInArrow(features, "key string, label int, feats array<int>").toArrow().sort_by("key")  # one order, whatever the tasks
    lists = sample.column("feats").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    w, b = regression(np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy().astype(np.int64), r, (sample.column("label").to_numpy() == 1).astype(float), l2, steps)
    return Model(slots, w * r, float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs(doc_id, text), over its whole text.

    A null or empty text has no feature and gets the bias's score. Repeated rows stay; other columns are ignored.
    """
    table, weights, bias = model.table(), model.weights, model.bias
    held = docs.sparkSession.sparkContext.broadcast((table, weights))  # SLOTS entries, whatever the input
    del table, weights

    def run(batches):
        table, weights = held.value
        for batch in batches:
            rows, feats = hits(batch, 1, table)
            x = np.bincount(rows, weights[feats], batch.num_rows) if len(rows) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(x + bias, -40, 40))))], names=["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
