"""Exact and near duplicate photos by content hash and perceptual hash."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.sources import dims


def exact_duplicates(hashes: DataFrame) -> DataFrame:
    """sha256, n, first_id of contents that two or more photos have; null hashes form no group."""
    known = hashes.filter("sha256 IS NOT NULL")
    return known.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("photo_id").alias("first_id")).filter("n > 1")


def duplicate_members(hashes: DataFrame) -> DataFrame:
    """sha256, photo_id, first_id of every photo of those contents, a row each, so that no group has to fit one row."""
    return hashes.select("sha256", "photo_id").join(exact_duplicates(hashes).select("sha256", "first_id"), "sha256").select("sha256", "photo_id", "first_id")


def band_plan(values: int, most: int) -> tuple[int, int]:
    """(bands, bands a key): most + k bands of which two hashes near each other share k at least; k so that a key of
    k bands has few values of `values` by chance."""
    for k in range(1, 5):
        if 2 ** (64 * k // (most + k)) >= values / 4 or k == 4:
            return most + k, k
    raise AssertionError


def near_duplicates(hashes: DataFrame, most: int = dims.NEAR_HASH_BITS, exclude_exact: bool = False, plan: tuple[int, int] | None = None) -> DataFrame:
    """a, b (a < b), distance of photos of hashes(photo_id, bits bigint) at most `most` bits apart.

    The 64 bits are cut into bands; each choice of k of them is a key, and two hashes within `most` bits have an equal
    key, so an equality join on keys misses none. More hashes take longer keys (band_plan), so that the values that
    share one by chance stay few. Equal hashes are collapsed first and expanded to the least photo of each: a row
    stands for a pair of values, and pairs inside one value are listed against its least photo only.
    """
    known = hashes.filter("bits IS NOT NULL").select("photo_id", "bits")
    values = known.groupBy("bits").agg(F.min("photo_id").alias("head"))
    n, k = plan or band_plan(values.count(), most)
    edges = [round(i * 64 / n) for i in range(n + 1)]
    band = [F.shiftrightunsigned(F.shiftleft("bits", 64 - edges[i + 1]), 64 - (edges[i + 1] - edges[i])) for i in range(n)]
    keys = F.array(*(F.xxhash64(F.lit(number), *(band[i] for i in chosen)) for number, chosen in enumerate(combinations(range(n), k))))
    rows = values.withColumn("key", F.explode(keys))
    x, y = rows.alias("x"), rows.alias("y")
    distance = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.head") < F.col("y.head")) & (distance <= most))
    pairs = pairs.select(F.col("x.head").alias("a"), F.col("y.head").alias("b"), distance.cast("int").alias("distance")).distinct()
    if exclude_exact:
        return pairs
    equal = known.join(values, "bits").filter("photo_id <> head").select(F.col("head").alias("a"), F.col("photo_id").alias("b"), F.lit(0).alias("distance"))
    return pairs.unionByName(equal)
