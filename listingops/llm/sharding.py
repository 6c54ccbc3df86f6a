"""Sharding: longest-processing-time scheduling of groups that must stay together.

Groups of equal key are the units. The scheduler itself must not see every group, so units are bundled first:

* a group heavier than total / (shards * heavy_per_shard) is a unit of its own; there are at most
  shards * heavy_per_shard of those, whatever the input;
* the other groups fall, by a hash of their key, into tiers of bundles; each tier's bundles weigh a sixteenth of those
  before, so that the last units scheduled are tiny and level the shards.

Units go, heaviest first, to the least-loaded shard through a heap. Their number has a fixed bound, so the heap runs on
the driver over sums that Spark made; rows never leave the executors.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import ranked_in, salts, written

TIERS = ((1024, 15 / 16), (1024, 15 / 256), (1024, 1 / 256))  # bundles and their share of the light groups


def schedule(weights: dict[str, int], shards: int) -> dict[str, int]:
    """Longest processing time first; equal weights and loads by name and number, so that a rerun gives the same."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[unit] = s
        heapq.heappush(heap, (load + w, s))
    return out


def bundle_of(key: str):
    """The light bundle of a group: a tier by one part of the key's hash, a bundle by another."""
    u = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    v = F.xxhash64(F.lit(12), F.col(key))
    col, low = None, 0.0
    for t, (n, share) in enumerate(TIERS):
        name = F.concat(F.lit(f"t{t}:"), F.pmod(v, F.lit(n)).cast("string"))
        col = F.when(u < low + share, name) if col is None else col.when(u < low + share, name)
        low += share
    return col.otherwise(F.lit(f"t{len(TIERS) - 1}:0"))


def shard_groups(rows: DataFrame, key: str, size: str, shards: int, heavy_per_shard: int = 512) -> DataFrame:
    """rows with shard (int): equal keys together, sums of size near equal. Null keys form one group.

    rows is read three times; pass a written table. Empty input gives empty output.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(size)).first()[0] or 0
    limit = max(1, total // (shards * heavy_per_shard))
    keyed = rows.withColumn("_key", F.coalesce(F.col(key), F.lit("")))
    groups = keyed.groupBy("_key").agg(F.sum(size).alias("_w"))
    heavy = groups.filter(F.col("_w") > limit).select("_key", F.concat(F.lit("g:"), "_key").alias("_heavy"))
    heavy_units = [(r["_key"], r["_heavy"]) for r in heavy.collect()]  # shards * heavy_per_shard at most
    schema = "_key string, _heavy string"
    dealt = keyed.join(F.broadcast(spark.createDataFrame(heavy_units, schema)), "_key", "left").withColumn("_unit", F.coalesce("_heavy", bundle_of("_key")))
    weights = {r[0]: r[1] for r in dealt.groupBy("_unit").agg(F.sum(size)).collect()}  # bounded by units, not rows
    plan = spark.createDataFrame(sorted(schedule(weights, shards).items()), "_unit string, shard int")
    return dealt.join(F.broadcast(plan), "_unit").drop("_key", "_heavy", "_unit")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, text_key, shard, slot of every row of docs(doc_id, text).

    size is the UTF-8 bytes of the text plus 1; a null text has none and counts as the empty text. Equal texts share a
    shard. slot is gapless from 0 within a shard. Repeated rows are rows of their own; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("text_key")), "sizes")
    dealt = shard_groups(measured, "text_key", "size", shards)
    return ranked_in(dealt, ["shard"], ["doc_id", "text_key"], salts(measured.count()), "slot")
