"""Line dedup: winnowing over line hashes.

A line ends at a line feed, or at a word that ends in . ! or ? before a blank, so that running prose has lines too. A
block is the shortest run of lines, from one line on, of at least min_words words. Winnowing selects in each window of
`window` consecutive blocks the one of least hash, so that any repeated run of that many blocks has a selected block in
common, whatever surrounds it. Blocks of one line, and blocks of long_words words or more, are selected besides, in
any window, so that a repeated run of one such block, as a single line or sentence of min_words words is, is found too.

A match at a selected block is extended line by line, both ways, until another selected block is sure to take over: to
the left by window - 1 lines, to the right as long as the block that starts `window` lines after is not whole. Block and
extensions are ranges of lines, each with a hash; a range that has an earlier place, by (doc_id, text key, line), is
deleted. Each length is joined to the first place of its own, so that a run is held against all earlier texts at once.

What is guaranteed: every line of a run that occurs before (in an earlier document, or earlier in its own) and that has
`window` consecutive blocks, a line of min_words words or a block of long_words words is deleted, and the first place of
any line stays. Only whole lines are deleted: a passage that starts or ends inside a line loses the whole lines within
it. Runs of fewer blocks, each of short lines and under long_words words in all, go where winnowing selected them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingops.llm.common import discard, if_small, ship, written
from listingops.llm.words import buffers_of, hashes_of_long, mixed, powers, runs

U = np.uint64
STOP = np.zeros(256, dtype=bool)
STOP[list(b".!?")] = True


@dataclass(frozen=True)
class Lines:
    """The lines of some texts: hash, words, first and last byte; text t has the lines bounds[t] : bounds[t + 1].

    A line is made of words: lines without words are none, white space and the case of A-Z don't count.
    """

    hashes: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    h, starts, ends = hashes_of_long(data, offsets)
    if not len(h):
        return Lines(h, starts, starts, ends, np.zeros(len(offsets), np.int64))
    feeds = np.concatenate((np.zeros(1, np.int32), np.cumsum(data == 10, dtype=np.int32)))
    new = np.ones(len(h), dtype=bool)
    gap = ends[:-1]
    new[1:] = (feeds[starts[1:]] > feeds[gap]) | (STOP[data[gap - 1]] & (data[gap] == 32))
    first_words = np.searchsorted(starts, offsets)
    new[first_words[first_words < len(h)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h))
    return Lines(_ranged(h, first, last), last - first, starts[first], ends[last - 1], np.searchsorted(first, first_words))


def _ranged(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of h[first : last] in order, for each pair."""
    up, down = powers(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
        return mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def blocks(lines: Lines, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, end, hash, words) of the block that starts at each line, where the text has enough words from there on."""
    words = np.concatenate(([0], np.cumsum(lines.words)))
    end = np.searchsorted(words, words[:-1] + min_words)
    text_end = np.repeat(lines.bounds[1:], np.diff(lines.bounds))
    at = np.flatnonzero(end <= text_end)
    return at, end[at], _ranged(lines.hashes, at, end[at]), words[end[at]] - words[at]


def winnowed(at: np.ndarray, b: np.ndarray, long: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Which blocks some window of consecutive blocks of a text selects, or are to be selected anyway (long).

    A text with fewer blocks than a window has one window of them all.
    """
    chosen = long.copy()
    text = np.searchsorted(bounds, at, side="right")  # blocks of a text start at consecutive lines
    sizes = np.bincount(text, minlength=1)
    for w in range(1, window + 1):
        if len(b) < w:
            break
        view = np.lib.stride_tricks.sliding_window_view(b, w)
        whole = text[: len(view)] == text[w - 1 :]
        if w < window:
            whole &= sizes[text[: len(view)]] == w
        i = np.flatnonzero(whole)
        chosen[i + w - 1 - np.argmin(view[i][:, ::-1], axis=1)] = True  # the last of equal ones
    return chosen


def ranges_of(lines: Lines, min_words: int, window: int, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, end, hash) of every selected block and its extensions, by first line and end."""
    at, end, b, n = blocks(lines, min_words)
    pick = winnowed(at, b, (n >= long_words) | (end - at == 1), lines.bounds, window)
    at, end = at[pick], end[pick]
    words = np.concatenate(([0], np.cumsum(lines.words)))
    text = np.searchsorted(lines.bounds, at, side="right")
    low, high = lines.bounds[text - 1], lines.bounds[text]
    starts, ends = [at], [end]
    for j in range(1, window):
        ok = at - j >= low
        starts.append(at[ok] - j)
        ends.append(end[ok])
    s, e, high = at, end + 1, high
    while len(s):
        ok = e <= high
        s, e, high = s[ok], e[ok], high[ok]
        ok = words[e] - words[np.minimum(s + window, e)] < min_words
        s, e, high = s[ok], e[ok], high[ok]
        starts.append(s)
        ends.append(e)
        e = e + 1
    s, e = np.concatenate(starts), np.concatenate(ends)
    by = np.lexsort((e, s))
    return s[by], e[by], _ranged(lines.hashes, s[by], e[by])


FOUND = "doc_id long, key long, hashes array<long>, starts array<int>, ends array<int>, deleted_starts array<int>, deleted_ends array<int>"


class Held:
    """The ranges of some documents of a task. Of equal ranges only the first can matter to other documents."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.lines: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, ids: np.ndarray, keys: np.ndarray, lines: Lines, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        s, e, h = found
        cut = np.searchsorted(s, lines.bounds)
        base = np.repeat(lines.bounds[:-1], np.diff(cut))
        self.docs.append(np.stack((ids, keys), axis=1))
        self.sizes.append(np.diff(cut))
        self.lines.append(np.diff(lines.bounds))
        self.parts.append((s - base, e - base, h))
        self.n += len(s)

    def flush(self, schema: pa.Schema) -> pa.RecordBatch:
        """FOUND: each range that is the first of its hash here, and the lines that ranges after the first cover."""
        docs, sizes, n_lines = np.concatenate(self.docs), np.concatenate(self.sizes), np.concatenate(self.lines)
        s, e, h = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        _, rank = np.unique(docs, axis=0, return_inverse=True)
        doc = np.repeat(np.arange(len(docs)), sizes)
        place = rank.reshape(-1)[doc]
        by = np.lexsort((s, place, h))
        new = np.concatenate((np.ones(1, bool), h[by][1:] != h[by][:-1]))[: len(by)]
        head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
        later = np.zeros(len(s), bool)
        later[by] = (place[by] != place[head]) | (s[by] != s[head])  # a repeated row of one document is no repeat
        first = np.zeros(len(s), bool)
        first[by[new]] = True
        base = np.concatenate(([0], np.cumsum(n_lines)))
        depth = np.bincount(base[doc[later]] + s[later], minlength=base[-1] + 1) - np.bincount(base[doc[later]] + e[later], minlength=base[-1] + 1)
        gone = np.cumsum(depth[:-1]) > 0
        start, end = gone.copy(), gone.copy()
        start[1:] &= ~gone[:-1]
        end[:-1] &= ~gone[1:]
        edge = base[1:-1][(base[1:-1] > 0) & (base[1:-1] < len(gone))]  # no range goes on into the next document
        start[edge] |= gone[edge]
        end[edge - 1] |= gone[edge - 1]
        out_s, out_e = np.flatnonzero(start), np.flatnonzero(end) + 1
        of = np.searchsorted(base, out_s, side="right") - 1

        def lists(x: np.ndarray, owner: np.ndarray, kind: pa.DataType) -> pa.Array:
            offsets = np.searchsorted(owner, np.arange(len(docs) + 1))
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind))

        ours = doc[first]
        columns = [pa.array(docs[:, 0]), pa.array(docs[:, 1]), lists(h[first].view(np.int64), ours, pa.int64()), lists(s[first].astype(np.int32), ours, pa.int32()), lists(e[first].astype(np.int32), ours, pa.int32()), lists((out_s - base[of]).astype(np.int32), of, pa.int32()), lists((out_e - base[of]).astype(np.int32), of, pa.int32())]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _found(docs: DataFrame, min_words: int, window: int, long_words: int, at_once: int) -> DataFrame:
    whole = lambda t: pa.list_(t)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("hashes", whole(pa.int64())), *((c, whole(pa.int32())) for c in ("starts", "ends", "deleted_starts", "deleted_ends"))])

    def run(batches):
        held = Held()
        for batch in batches:
            data, offsets = buffers_of(batch.column(2))
            ids, keys = (batch.column(c).to_numpy() for c in (0, 1))
            for i, j in runs(offsets):
                lines = lines_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.add(ids[i:j], keys[i:j], lines, ranges_of(lines, min_words, window, long_words))
                if held.n >= at_once:
                    yield held.flush(schema)
        if held.docs:
            yield held.flush(schema)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, FOUND)


def repeated_runs(docs: DataFrame, min_words: int = 8, window: int = 2, long_words: int = 20, at_once: int = 1 << 20) -> DataFrame:
    """doc_id, key and deleted array<struct<s,e>> (line ranges, sorted, disjoint) of documents with repeats, as a written table.

    key is a hash of the text: rows equal in doc_id and text are one document. Null texts and doc_ids take no part. A
    task passes equal ranges on once for every at_once ranges that it has read, so a line that a third of all documents
    hold makes no large group: its rows are as many as tasks.
    """
    own = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    table = written(_found(own, min_words, window, long_words, at_once), "ranges")
    marks = table.select("doc_id", "key", F.explode(F.arrays_zip("hashes", "starts", "ends")).alias("m")).select(F.col("m.hashes").alias("h"), "doc_id", "key", F.col("m.starts").alias("s"), F.col("m.ends").alias("e"))
    place = F.struct("doc_id", "key", "s")
    later = marks.withColumn("first", F.min(place).over(Window.partitionBy("h"))).filter(place > F.col("first")).select("doc_id", "key", "s", "e")
    here = table.select("doc_id", "key", F.explode(F.arrays_zip("deleted_starts", "deleted_ends")).alias("m")).select("doc_id", "key", F.col("m.deleted_starts").alias("s"), F.col("m.deleted_ends").alias("e"))
    order = Window.partitionBy("doc_id", "key").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = later.unionByName(here).withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    merged = spans.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "key", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    out = written(merged.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("deleted")), "deleted")  # no more than a document's lines
    discard(table)
    return out


def without(text: str, deleted: list[tuple[int, int]]) -> str:
    """text without the lines of the ranges; a kept line keeps the white space after it, the last one none."""
    raw = text.encode("utf-8", "surrogatepass")
    lines = lines_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    gone = np.zeros(len(lines.starts), bool)
    for s, e in deleted:
        gone[s:e] = True
    kept = np.flatnonzero(~gone)
    ends = [lines.ends[i] if i == kept[-1] else lines.starts[i + 1] for i in kept]
    return b"".join(raw[lines.starts[i] : e] for i, e in zip(kept, ends, strict=True)).decode("utf-8", "surrogatepass")


def dedup_lines(docs: DataFrame, min_words: int = 8, window: int = 2, long_words: int = 20, at_once: int = 1 << 20) -> DataFrame:
    """docs with text cleaned of later repeated runs, and deleted_lines (line ranges; null where nothing went).

    Every row and column stays, also rows with a null text or doc_id, which are left as they are; a document that is
    all repeats has an empty text. Rows equal in doc_id and text are cleaned alike. A column of docs that is named
    deleted_lines is replaced.
    """
    runs = repeated_runs(docs, min_words, window, long_words, at_once).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("deleted").alias("_deleted"))
    runs = if_small(runs)
    joined = docs.join(runs, (F.col("doc_id").cast("long") == F.col("_d")) & (F.xxhash64("text") == F.col("_k")), "left")

    @F.pandas_udf("string")
    def clean(text: pd.Series, deleted: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without(t, [(x["s"], x["e"]) for x in d]) for t, d in zip(text, deleted, strict=True)])

    gone = F.col("_deleted").isNotNull()
    once = clean.asNondeterministic()  # else a filter on the text runs it again, in workers of its own
    cleaned = joined.withColumn("_clean", once(F.when(gone, F.col("text")), "_deleted"))  # other texts don't go to Python
    text = F.when(gone, F.col("_clean")).otherwise(F.col("text")).alias("text")
    return cleaned.select(*(text if c == "text" else F.col(c) for c in docs.columns if c != "deleted_lines"), F.col("_deleted").alias("deleted_lines"))
