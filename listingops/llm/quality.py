"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one and two words), one of target text and one of raw text, give each
document its log importance weight, the sum over its n-grams of log p_target - log p_raw. Gumbel noise makes the k
largest noisy weights a sample without replacement in proportion to the weights (Gumbel top-k).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import ship, written
from listingops.llm.words import mixed, word_hashes

BITS = 18
BUCKETS = 1 << BITS
U = np.uint64


def ngram_buckets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every one- and two-word n-gram."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    one = (h >> U(64 - BITS)).astype(np.int64)
    with np.errstate(over="ignore"):
        two = (mixed(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) >> U(64 - BITS)).astype(np.int64)
    same = row[:-1] == row[1:]
    return np.concatenate((row, row[:-1][same])), np.concatenate((one, two[same]))


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray


def sampled(labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """doc_id, quality, fold (0: fits the target model, 1: sets the cut) of at most rows labelled rows, by a hash of doc_id."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    return known.orderBy(h, "doc_id").limit(rows).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 50_000, prior: float = 50.0, seed: int = 5) -> Model:
    """The models: raw from every row of docs(doc_id, text), target from labels(doc_id, quality) with quality 1.

    sample_rows bounds the labelled rows; half of them fit the target model. They are broadcast, so no text is
    shuffled. Counts leave a task once, one row for each bucket. prior is how many n-grams of either kind a bucket
    starts with, so that buckets with few say little: the target sample lacks most rare n-grams of its own kind, and the
    sum over a long text would add that up.
    """
    spark = docs.sparkSession
    ship(spark)
    good = sampled(labels, sample_rows, seed).filter("quality = 1 AND fold = 0").select(F.col("doc_id").alias("_id"), F.lit(True).alias("target"))
    both = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def count(batches):
        seen = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, h, bounds in word_hashes(batch.column(0)):
                row, bucket = ngram_buckets(h, bounds)
                seen[0] += np.bincount(bucket, minlength=BUCKETS)
                seen[1] += np.bincount(bucket[target[row + i]], minlength=BUCKETS)
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[0, at]), pa.array(seen[1, at])], schema=schema)

    sums = both.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    share = target.sum() / max(1.0, raw.sum())
    return Model(np.log((target + prior) / (raw * share + prior)) if share else np.zeros(BUCKETS))


def weigh(docs: DataFrame, model: Model, seed: int = 9) -> DataFrame:
    """doc_id, text_key, n_grams, log_weight and gumbel_key = log_weight + Gumbel noise of every row of docs(doc_id, text).

    text_key is xxhash64 of the text. The noise is a function of doc_id, text and seed, so a rerun draws the same. Null
    and empty texts have weight 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.log_ratio)

    def run(batches):
        ratio = held.value
        for batch in batches:
            n, x = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, h, bounds in word_hashes(batch.column(2)):
                row, bucket = ngram_buckets(h, bounds)
                n[i:j] = np.bincount(row, minlength=j - i)
                x[i:j] = np.bincount(row, ratio[bucket], minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(x)], names=["doc_id", "text_key", "n_grams", "log_weight"])

    ship(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    out = keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_grams long, log_weight double")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return out.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 1024, few: int = 10_000) -> tuple[float | None, int]:
    """(the k-th largest value of key, how many rows lie above it); (None, rows) with fewer than k rows.

    Rows are counted in ever finer bins of a fixed number until the bin that holds the value has few rows or one value;
    no sort of all rows, and nothing but bin counts or few values on the driver. df is read several times.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return None, 0
    above = 0
    while True:
        inside = df.filter((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / bins
        b = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int")) if width > 0 else F.lit(0)
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(b.alias("b")).agg(F.count(F.lit(1)), F.min(key), F.max(key)).collect()}
        for at in sorted(counts, reverse=True):
            n, low, high = counts[at]
            if above + n >= k:
                break
            above += n
        else:
            return None, above
        if low == high:
            return low, above
        if n <= few:
            values = sorted((r[0] for r in df.filter((F.col(key) >= low) & (F.col(key) <= high)).select(key).collect()), reverse=True)
            value = values[k - above - 1]
            return value, above + sum(v > value for v in values)


def top_k(weighed: DataFrame, key: str, k: int, tie: str) -> DataFrame:
    """weighed with selected: whether the row is among the k largest of key, ties to the smaller tie (a number).

    Rows equal in key and tie are selected together. With k of all rows or more, all are; with k of 0, none.
    weighed is read several times: pass a written table.
    """
    if k <= 0:
        return weighed.withColumn("selected", F.lit(False))
    cut, above = kth_largest(weighed, key, k)
    if cut is None:
        return weighed.withColumn("selected", F.lit(True))
    last, _ = kth_largest(weighed.filter(F.col(key) == cut).select((-F.col(tie)).alias("t")), "t", k - above)
    tied = (F.col(key) == cut) & (F.col(tie) <= F.lit(-last)) if last is not None else F.lit(False)
    return weighed.withColumn("selected", F.coalesce((F.col(key) > cut) | tied, F.lit(False)))


def expected_good(weighed: DataFrame, labels: DataFrame, lost_cost: float = 4.0, sample_rows: int = 50_000, seed: int = 5) -> int:
    """How many rows weigh as labelled good text does.

    The cut is the log_weight with the least cost on the labelled rows that did not fit the target model, where a lost
    good row costs lost_cost kept bad ones; the number of rows above it is returned. Without both kinds: every row.
    """
    some = sampled(labels, sample_rows, seed).filter("quality = 0 OR fold = 1")
    got = weighed.join(F.broadcast(some), "doc_id").select("log_weight", "quality").toPandas().sort_values("log_weight")
    if got["quality"].nunique() < 2:
        return weighed.count()
    good, bad = (got["quality"] == 1).to_numpy(), (got["quality"] == 0).to_numpy()
    cost = lost_cost * np.concatenate(([0], np.cumsum(good))) + bad.sum() - np.concatenate(([0], np.cumsum(bad)))
    at, x = int(np.argmin(cost)), got["log_weight"].to_numpy()
    cut = float("-inf") if at == 0 else float((x[at - 1] + x[min(at, len(x) - 1)]) / 2)
    return weighed.filter(F.col("log_weight") >= cut).count()


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, text_key, n_grams, log_weight, gumbel_key and selected of every row of docs(doc_id, text).

    k rows are selected; without k, as many as weigh like labelled good text (expected_good). Null and empty texts have
    weight 0 and are drawn like others. Rows equal in doc_id and text are selected together.
    """
    weighed = written(weigh(docs, fit(docs, labels)), "weighed")
    return top_k(weighed, "gumbel_key", expected_good(weighed, labels) if k is None else k, "doc_id")
