"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Each benchmark item's words make one SimHash of 48 bits. Every window of as many words in every document gets its own,
by sums that slide. The fingerprint is cut into three blocks of 16 bits; an index holds each item's blocks and all
blocks one bit away. Two fingerprints at most RADIUS = 5 bits apart agree in some block up to one bit, so no pair within
the radius is missed. No radius holds all that the threshold accepts: a change of one word can turn many bits of a short
item, and words of small weight may change at will. So a second index holds of each item the heaviest shingles that
weigh more than a similar window may lack together. Every window that is similar enough has one of them, and all windows
around such a place are candidates too. Candidates are then compared exactly: weighted Jaccard similarity of their
five-word shingles, each with its multiplicity and a weight of 1 / (items of the whole benchmark that hold it).
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import ship, written
from listingops.llm.words import shingles, word_hashes

RADIUS, BLOCKS, BLOCK_BITS, SHINGLE = 5, 3, 16, 5
BITS = BLOCKS * BLOCK_BITS
ITEMS_A_PASS = 5_000
STEP = 4096  # words whose sums are held at once
SIEVE = np.uint64((1 << 20) - 1)  # bits of a shingle that are looked up first


def sums_of(h: np.ndarray, kind: type) -> np.ndarray:
    """Running sums, for each bit, of +1 where a word's hash has it and -1 where not; modulo the type's range."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, : BITS // 8], axis=1, bitorder="little").view(np.int8)
    out = np.zeros((len(h) + 1, BITS), dtype=kind)
    np.cumsum(bits * np.int8(2) - np.int8(1), axis=0, dtype=kind, out=out[1:])
    return out


def window_fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """(windows, BLOCKS) SimHash of each window of size words: a bit is set where more words have it than not."""
    return np.packbits(((sums[size:] - sums[:-size]) > 0).ravel(), bitorder="little").view(np.uint16).reshape(-1, BLOCKS)


def simhash(h: np.ndarray) -> np.ndarray:
    return window_fingerprints(sums_of(h, np.int32), len(h))[0]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits by which each row of a differs from each row of b."""
    whole = lambda x: x.astype(np.uint64) @ np.array([1 << BLOCK_BITS * i for i in range(BLOCKS)], dtype=np.uint64)
    return np.bitwise_count(whole(a)[:, None] ^ whole(b)[None, :])


class Items:
    """The benchmark items of one pass by size, with their block indexes."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], least: float = 0.8, shared: dict[int, int] | None = None):
        """shared: the number of items of the whole benchmark that hold a shingle, where it is more than one."""
        shingled = {k: Counter(shingles(h, SHINGLE).tolist()) for k, h in rows}
        held = Counter(s for c in shingled.values() for s in c) if shared is None else shared
        self.weight = {s: 1.0 / n for s, n in held.items()}
        self.items: dict[int, tuple[np.ndarray, list[int], np.ndarray, np.uint8]] = {}  # by size: fingerprints, items, blocks
        self.shingles = shingled
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.size = {k: len(h) for k, h in rows}
        for k, h in rows:
            if len(h):
                by_size.setdefault(len(h), []).append((k, h))
        near = np.concatenate(([0], 1 << np.arange(BLOCK_BITS)))
        # eight sizes share a table of bytes, a bit for each, so that the tables stay in the processor's cache
        self.tables = np.zeros((-(-len(by_size) // 8), BLOCKS, 1 << BLOCK_BITS), dtype=np.uint8)
        for n, (size, own) in enumerate(sorted(by_size.items())):
            prints = np.array([simhash(h) for _, h in own], dtype=np.uint16)
            bit = np.uint8(1 << n % 8)
            for b, part in enumerate(prints.T):
                self.tables[n // 8, b, (part[:, None] ^ near[None, :]).ravel()] |= bit
            self.items[size] = (prints, [k for k, _ in own], self.tables[n // 8], bit)
        self.least = least
        self.total: dict[int, float] = {}
        self.needed: dict[int, dict[int, list[int]]] = {}  # by words of a shingle: the items that need it or another of theirs
        for k, own in shingled.items():
            weighed = sorted(((self.weight.get(s, 1.0) * n, s) for s, n in own.items()), key=lambda x: (-x[0], x[1]))
            self.total[k], lacking = sum(w for w, _ in weighed), 0.0
            by = self.needed.setdefault(min(self.size[k], SHINGLE), {})
            for w, s in weighed:
                by.setdefault(s, []).append(k)
                lacking += w
                if lacking > (1 - least) * self.total[k] + 1e-9:
                    break
        self.sieves = {}
        for m, by in self.needed.items():
            self.sieves[m] = np.zeros(int(SIEVE) + 1, dtype=bool)
            self.sieves[m][(np.fromiter(by, np.uint64, len(by)) & SIEVE).astype(np.int64)] = True

    def similarity(self, item: int, window: Counter) -> float:
        own = self.shingles[item]
        less = more = 0.0
        for s in own.keys() | window.keys():
            w = self.weight.get(s, 1.0)
            less += w * min(own[s], window[s])
            more += w * max(own[s], window[s])
        return less / more

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, position, size) of all windows of the words h within RADIUS of an item."""
        out: list[tuple[int, int, int]] = []
        sizes = [s for s in self.items if s <= len(h)]
        if not sizes:
            return out
        kind, reach = (np.int8 if max(sizes) <= 127 else np.int32), max(sizes)
        for low in range(0, len(h), STEP):
            sums = sums_of(h[low : low + STEP + reach - 1], kind)
            for size in sizes:
                if len(sums) <= size:
                    continue
                prints, keys, table, bit = self.items[size]
                own = window_fingerprints(sums, size)[:STEP]
                part = np.ascontiguousarray(own.T)
                at = np.flatnonzero((table[0].take(part[0]) | table[1].take(part[1]) | table[2].take(part[2])) & bit)
                if len(at):
                    near = apart(own[at], prints) <= RADIUS
                    if near.any():
                        out += [(keys[j], low + int(at[i]), size) for i, j in zip(*np.nonzero(near), strict=True)]
        return out

    def around_needed(self, h: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(item, position) of all windows that hold a needed shingle and enough weight of the item's shingles.

        A window has as many words as the item, or fewer at its text's end.
        """
        out: set[tuple[int, int]] = set()
        for m, by in self.needed.items():
            if not m or len(h) < m:
                continue
            x = shingles(h, m)
            at = np.flatnonzero(self.sieves[m].take((x & SIEVE).astype(np.int64)))
            text = np.searchsorted(bounds, at, side="right") - 1
            inside = at + m <= bounds[text + 1]
            hits: dict[tuple[int, int], list[list[int]]] = {}
            for p, t in zip(at[inside].tolist(), text[inside].tolist(), strict=True):
                for k in by.get(int(x[p]), ()):
                    groups = hits.setdefault((t, k), [])
                    if groups and p - groups[-1][1] < self.size[k]:
                        groups[-1][1] = p
                    else:
                        groups.append([p, p])
            for (t, k), groups in hits.items():
                n, own, end = self.size[k], self.shingles[k], int(bounds[t + 1])
                for p, q in groups:
                    low = max(int(bounds[t]), p - n + m)
                    w = [self.weight.get(s, 1.0) if s in own else 0.0 for s in x[low : min(q + n, end) - m + 1].tolist()]
                    sums, start = np.concatenate(([0.0], np.cumsum(w))), np.arange(low, q + 1)
                    held = sums[np.minimum(start + n, end) - m + 1 - low] - sums[start - low]
                    out.update((k, i) for i in start[held >= self.least * self.total[k] - 1e-6].tolist())
        return out

    def matches(self, h: np.ndarray, bounds: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item, position, size, similarity) in the texts with the words h[bounds[t] : bounds[t + 1]].

        Of overlapping windows of one item: the most similar, then the first. No window crosses a text's end: there, and
        in a text shorter than the item, it has the words that are left.
        """
        text_of = lambda at: int(np.searchsorted(bounds, at, side="right")) - 1
        near = {(k, at) for k, at, size in self.candidates(h) if at + size <= bounds[text_of(at) + 1]}
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for k, at in near | self.around_needed(h, bounds):
            t = text_of(at)
            size = int(min(self.size[k], bounds[t + 1] - at))
            x = self.similarity(k, Counter(shingles(h[at : at + size], SHINGLE).tolist()))
            if x >= least:
                found.setdefault((t, k), []).append((-x, at - int(bounds[t]), size))
        best: list[tuple[int, int, int, int, float]] = []
        for (t, k), own in sorted(found.items()):
            taken: list[tuple[int, int]] = []  # start and end, disjoint, sorted
            for x, at, size in sorted(own):
                i = bisect.bisect(taken, (at, at))
                if (i == 0 or taken[i - 1][1] <= at) and (i == len(taken) or at + size <= taken[i][0]):
                    taken.insert(i, (at, at + size))
                    best.append((t, k, at, size, -x))
        return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity, text_key: windows of docs(doc_id, text) that repeat an item of
    benchmark(item_id, text) with a similarity of at least `least`. start counts words from 0; text_key is xxhash64 of
    the document's text.

    Documents are never shuffled. The benchmark is sent to the tasks items_a_pass items at a time, about; a larger one
    takes more passes, each written before the next begins, with the same rows. Of the shingles that several items share
    a pass gets those of its own items. Null and empty texts and
    items match nothing, a text shorter than an item is held against it whole; repeated rows match each, a null doc_id
    stays null; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id", "text"])
    passes = max(1, -(-items.count() // items_a_pass))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    often = written(_shingles(items).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-shingles")
    out = None
    for p in range(passes):
        own = items.filter(slot == p)
        part = own.orderBy("item_id", "text").collect()
        texts = pa.array([r["text"] for r in part], pa.string())
        keys = [r["item_id"] for r in part]
        rows = [(n, h[b[n - i] : b[n - i + 1]]) for i, j, h, b in word_hashes(texts) for n in range(i, j)]
        known = often.join(_shingles(own).distinct(), "s").toArrow()  # no more than the shingles of the pass's items
        shared = dict(zip(known["s"].combine_chunks().to_numpy().view(np.uint64).tolist(), known["n"].to_pylist(), strict=True))
        held = spark.sparkContext.broadcast((rows, shared))
        found = _scan(docs, keys, least, held)
        if passes > 1:
            found = written(found, "leaks")
            held.unpersist()
        out = found if out is None else out.union(found)
    return out


def _shingles(items: DataFrame) -> DataFrame:
    """s: the distinct shingles of each row of items(text)."""
    schema = pa.schema([("s", pa.int64())])

    def run(batches):
        for batch in batches:
            for i, j, h, b in word_hashes(batch.column(0)):
                own = [np.unique(shingles(h[b[n] : b[n + 1]], SHINGLE)) for n in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], schema=schema)

    return items.select("text").mapInArrow(run, "s long")


def _scan(docs: DataFrame, keys: list[int], least: float, held: Broadcast) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64()), ("text_key", pa.int64())])

    def run(batches):
        rows, shared = held.value
        items = Items(rows, least, shared)
        for batch in batches:
            ids, text_keys, out = batch.column(0), batch.column(1), []
            for i, _, h, bounds in word_hashes(batch.column(2)):
                out += [(ids[i + t].as_py(), keys[k], at, size, x, text_keys[i + t].as_py()) for t, k, at, size, x in items.matches(h, bounds, least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, item_id long, start int, n_words int, similarity double, text_key long")
