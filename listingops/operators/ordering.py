"""Photo order within a product, platform limits, even sampling, and export manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions.text import slug_ok
from listingops.sources import dims


def suggested_order(photos: DataFrame) -> DataFrame:
    """photos(product_id, photo_id, name, sharpness, captured_at, mtime) with position (from 1) and criterion.

    Sharpest first where every photo of the product has a score, else the product is chronological: capture times,
    then file times, then names.
    """
    w = W.partitionBy("product_id")
    scored = F.count_if(F.col("sharpness").isNull()).over(w) == 0
    rows = photos.withColumn("criterion", F.when(scored, "sharpness").otherwise("chronological"))
    by_score = F.when(F.col("criterion") == "sharpness", -F.col("sharpness"))
    kind = F.when(F.col("criterion") == "sharpness", 0).when(F.col("captured_at").isNotNull(), 0).when(F.col("mtime").isNotNull(), 1).otherwise(2)
    at = F.when(F.col("criterion") == "chronological", F.coalesce("captured_at", "mtime"))
    return rows.withColumn("position", F.row_number().over(w.orderBy(by_score, kind, at, "name", "photo_id")))


def platform_photos(ordered: DataFrame) -> DataFrame:
    """ordered for each platform: platform, included (position within the platform's limit)."""
    limit = F.map_from_arrays(F.array(*(F.lit(p) for p in sorted(dims.PHOTO_LIMITS))), F.array(*(F.lit(dims.PHOTO_LIMITS[p]) for p in sorted(dims.PHOTO_LIMITS))))
    rows = ordered.withColumn("platform", F.explode(F.map_keys(limit)))
    return rows.withColumn("included", F.col("position") <= limit[F.col("platform")])


def manifest(ordered: DataFrame) -> DataFrame:
    """product_id, platform, photo_id, target, included, problem: files renamed slug_NN.ext up to the limit.

    ordered also has path and slug. A slug that is blank or holds a path character is a problem and gives no target.
    """
    rows = platform_photos(ordered)
    digits = F.greatest(F.lit(2), F.length(F.least(F.max("position").over(W.partitionBy("product_id", "platform")), F.lit(max(dims.PHOTO_LIMITS.values()))).cast("string")))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    ok = slug_ok(F.col("slug"))
    target = F.concat(F.trim("slug"), F.lit("_"), F.lpad(F.col("position").cast("string"), digits, F.lit("0")), ext)
    return rows.select("product_id", "platform", "photo_id", F.when(F.col("included") & ok, target).alias("target"), "included", F.when(~ok, "bad_slug").when(~F.col("included"), "over_limit").alias("problem"))


def even_sample(photos: DataFrame, k: int = dims.COLOUR_SAMPLE) -> DataFrame:
    """k photos of each product(product_id, position) spread over its sequence: round(i (n - 1) / (k - 1)), half to even."""
    w = W.partitionBy("product_id")
    rows = photos.withColumn("_i", F.row_number().over(w.orderBy("position")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / F.lit(max(1, k - 1))).cast("int"))
    return rows.filter((F.col("_n") <= k) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def missing_photos(listings: DataFrame, photos: DataFrame) -> DataFrame:
    """product_id, photo_id of listings(product_id, photos array) that photos(photo_id, path) lacks or has no path for."""
    asked = listings.select("product_id", F.explode("photos").alias("photo_id"))
    return asked.join(photos.filter("path IS NOT NULL").select("photo_id"), "photo_id", "left_anti").select("product_id", "photo_id")
