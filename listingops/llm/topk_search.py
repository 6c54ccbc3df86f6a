"""Exact top-k search over an impact-ordered index, score at a time.

Tasks index the vectors that they read in blocks; vectors are never shuffled. A block's index has, for each dimension,
the vectors' postings in segments of equal quantised value. A query takes the segments of all dimensions by descending quantised impact and adds each
impact to its vectors' accumulators. It stops on proof only: when no vector outside the few that may still be members
can reach the k-th best lower bound, whatever its unread postings hold. Possible members are then rescored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingops.llm.common import ship, written

LEVELS = 32
BATCH = 96  # segments between two looks at the proof


class Index:
    """Posting segments of one block: for each dimension the vectors by level, and the level's value range."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by]
        m, d = vectors.shape
        low = self.vectors.min(axis=0) if m else np.zeros(d, np.int64)
        high = self.vectors.max(axis=0) if m else np.zeros(d, np.int64)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = (self.vectors - low) // step
        self.order = np.argsort(level, axis=0, kind="stable").astype(np.int32)
        self.starts = np.stack([np.searchsorted(level[self.order[:, j], j], np.arange(LEVELS + 1)) for j in range(d)]) if d else np.empty((0, LEVELS + 1), np.int64)
        edges = low[:, None] + step[:, None] * np.arange(LEVELS + 1)
        self.floor, self.ceil = edges[:, :-1], np.minimum(edges[:, 1:] - 1, high[:, None])  # least and greatest value of a level
        self.low, self.high = low, high

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, without the vector whose id is own; ties to the smaller id."""
        m, d = self.vectors.shape
        up = query >= 0
        base = query * np.where(up, self.low, self.high)  # the least that a dimension can add
        least = np.where(up[:, None], query[:, None] * self.floor, query[:, None] * self.ceil) - base[:, None]
        most = np.where(up[:, None], query[:, None] * self.ceil, query[:, None] * self.floor) - base[:, None]
        sizes = np.diff(self.starts, axis=1)
        most = np.where(sizes > 0, most, -1)
        seg = np.argsort(-most, axis=None, kind="stable")
        seg = seg[most.ravel()[seg] > 0]
        rank = np.empty(most.size, np.int64)
        rank.fill(len(seg))
        rank[seg] = np.arange(len(seg))
        # what a dimension can still add after the first r segments: the greatest impact among its later ones
        dims, levels = np.divmod(seg, LEVELS)
        have = np.zeros(m)
        limit = max(8 * k, m // 64)
        possible = np.arange(m)
        width = (np.where(sizes > 0, most - least, 0)).max(axis=1, initial=0).sum()  # what flooring impacts can hide
        for r in range(0, len(seg), BATCH):
            part = slice(r, r + BATCH)
            ids = np.concatenate([self.order[self.starts[a, b] : self.starts[a, b + 1], a] for a, b in zip(dims[part], levels[part], strict=True)])
            gain = np.repeat(least[dims[part], levels[part]], sizes[dims[part], levels[part]])
            have += np.bincount(ids, gain, m)
            if m <= k + 1:
                continue
            later = np.zeros(d)
            np.maximum.at(later, dims[r + BATCH :], most[dims[r + BATCH :], levels[r + BATCH :]])
            bound = np.partition(have, m - k - 1)[m - k - 1]  # k + 1: one of them may be the query's own
            possible = np.flatnonzero(have + width + later.sum() >= bound)
            if len(possible) <= limit:
                break
        scores = self.vectors[possible] @ query
        ids = self.ids[possible]
        keep = ids != own
        scores, ids = scores[keep], ids[keep]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


class Best:
    """The k best rows of each of some queries over the blocks of a task."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, block_rows: int):
        self.queries, self.k, self.block_rows = queries, k, block_rows
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, ids: np.ndarray, vectors: pa.ListArray) -> None:
        bounds, values = vectors.offsets.to_numpy().astype(np.int64), vectors.values.to_numpy()
        sizes = np.diff(bounds)
        for d in np.unique(sizes).tolist():
            if d in self.queries:
                at = np.flatnonzero(sizes == d)
                own = self.held.setdefault(d, [])
                own.append((ids[at], values[bounds[at][:, None] + np.arange(d)]))
                if sum(len(x) for x, _ in own) >= self.block_rows:
                    self.search(d)

    def search(self, d: int) -> None:
        ids, vectors = (np.concatenate(x) for x in zip(*self.held.pop(d), strict=True))
        for low in range(0, len(ids), self.block_rows):
            index = Index(ids[low : low + self.block_rows], vectors[low : low + self.block_rows])
            for q, v in zip(self.queries[d][0].tolist(), self.queries[d][1], strict=True):
                new, scores = index.search(v, self.k, q)
                if q in self.found:
                    new, scores = np.concatenate((self.found[q][0], new)), np.concatenate((self.found[q][1], scores))
                    by = np.lexsort((new, -scores))[: self.k]
                    new, scores = new[by], scores[by]
                self.found[q] = new, scores

    def rows(self) -> Iterator[pa.RecordBatch]:
        for d in list(self.held):
            self.search(d)
        if self.found:
            ids, scores = (np.concatenate(x) for x in zip(*self.found.values(), strict=True))
            asked = np.repeat(np.fromiter(self.found, np.int64, len(self.found)), [len(x) for x, _ in self.found.values()])
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 8192, queries_a_pass: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query over all other rows.

    vectors(vec_id, v array<bigint>), queries(query_id, v). Each task indexes its rows in blocks of block_rows and
    passes on k rows for each query. Queries are sent to the tasks queries_a_pass at a time, about; more of them take
    more passes over the vectors, each written before the next begins, with the same rows. Components and products must
    keep the scores within 2 ** 53. Rows with the query's own id are not candidates; ties go to the
    smaller vec_id. Null vectors and vectors with a null component take no part; vectors of another length are not
    compared. Repeated query ids are one query, repeated vectors are rows each; other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    data = vectors.filter(whole("v") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v"))
    asked = written(queries.filter(whole("v") & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<long>").alias("v")).dropDuplicates(["query_id"]), "queries")
    passes = max(1, -(-asked.count() // queries_a_pass))
    ship(spark)
    found = None
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).collect()  # queries_a_pass, about
        by_size: dict[int, list] = {}
        for r in part:
            by_size.setdefault(len(r["v"]), []).append(r)
        held = spark.sparkContext.broadcast({d: (np.array([r["query_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64).reshape(len(own), d)) for d, own in by_size.items()})

        def run(batches, held=held):
            best = Best(held.value, k, block_rows)
            for batch in batches:
                for low in range(0, batch.num_rows, block_rows):
                    some = batch.slice(low, block_rows)
                    best.add(some.column(0).to_numpy(), pa.concat_arrays([some.column(1)]))
            yield from best.rows()

        new = data.mapInArrow(run, "query_id long, vec_id long, score long")
        del part, by_size
        if passes > 1:  # one pass's queries at a time
            new = written(new, "found")
            held.unpersist()
        found = new if found is None else found.union(new)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embedding: str, scale: int = 1024):
    """floor(scale * x) of every component, or null for a null vector or one with a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = F.col(embedding).isNotNull() & F.forall(embedding, finite)
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))
