"""Request planning, reuse of paid answers, and usage accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingops.functions.numbers import usage_cost
from listingops.sources import dims


def request_key(images: Column, model: Column, version: Column, prompt: Column) -> Column:
    """SHA-256 over the image hashes in order, model, version and prompt."""
    return F.sha2(F.concat_ws("\x00", F.array_join(images, "\x01"), model, version, prompt), 256)


def usage_by(usage: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., calls, hits, tokens_in, tokens_out, cache_read, cost: answers from the cache add only to hits.

    usage: keys..., model, tokens_in, tokens_out, cache_read, cached. prices: model, price_in, price_out.
    """
    rows = usage.join(F.broadcast(prices), "model")
    paid = lambda c: F.coalesce(F.sum(F.when(~F.col("cached"), c)), F.lit(0))
    cost = usage_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))
    return rows.groupBy(*keys).agg(F.count_if(~F.col("cached")).alias("calls"), F.count_if("cached").alias("hits"), paid(F.col("tokens_in")).alias("tokens_in"), paid(F.col("tokens_out")).alias("tokens_out"), paid(F.col("cache_read")).alias("cache_read"), F.coalesce(F.sum(F.when(~F.col("cached"), cost)), F.lit(0.0)).alias("cost"))


def estimate(requests: DataFrame, cache: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """total, cached, payable, cost of requests(key, kind image or text, n_images) against cache(key, valid).

    A corrupt cache entry is a miss. Image requests without an image are invalid and not counted.
    """
    held = cache.filter("valid").select("key").distinct().withColumn("_hit", F.lit(True))
    rows = requests.filter((F.col("kind") == "text") | (F.col("n_images") > 0)).join(held, "key", "left")
    into = F.when(F.col("kind") == "image", F.col("n_images") * dims.IMAGE_TOKENS_IN).otherwise(dims.TEXT_TOKENS_IN)
    pay = F.col("_hit").isNull()
    cost = usage_cost(into, F.lit(dims.TOKENS_OUT), F.lit(price_in), F.lit(price_out))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~pay).alias("cached"), F.count_if(pay).alias("payable"), F.coalesce(F.sum(F.when(pay, cost)), F.lit(0.0)).alias("cost"))


def plan_requests(regions: DataFrame, samples: DataFrame, model: str, version: str, prompt: str) -> DataFrame:
    """product_id, key, kind, n_images: one image request for each kept region (photo_hash, box), and one for each
    product's sampled photos in order."""
    crop = F.concat_ws("_", "photo_hash", F.col("x").cast("string"), F.col("y").cast("string"), F.col("w").cast("string"), F.col("h").cast("string"))
    each = regions.filter("kept").select("product_id", F.array(crop).alias("images"))
    whole = samples.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "photo_hash"))), lambda x: x["photo_hash"]).alias("images"))
    rows = each.unionByName(whole)
    return rows.select("product_id", request_key(F.col("images"), F.lit(model), F.lit(version), F.lit(prompt)).alias("key"), F.lit("image").alias("kind"), F.size("images").alias("n_images"))


def crop_name(photo: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.format_string("%s_%d_%d_%d_%d.jpg", F.regexp_replace(photo, r"\.[^.]*$", ""), x, y, w, h)
