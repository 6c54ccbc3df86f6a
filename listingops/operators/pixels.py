"""Colour and sharpness over pixel tables (photo_id, x, y, r, g, b) and grey grids (photo_id, x, y, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions.numbers import lab
from listingops.sources import dims


def central(pixels: DataFrame) -> DataFrame:
    """The central half of each photo in both directions."""
    size = pixels.groupBy("photo_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    half = lambda c: F.greatest(F.floor(F.col(c) * 0.5 / 2), F.lit(1))
    mid = lambda c: F.floor(F.col(c) / 2)
    inside = (F.col("x") >= mid("_w") - half("_w")) & (F.col("x") < mid("_w") + half("_w")) & (F.col("y") >= mid("_h") - half("_h")) & (F.col("y") < mid("_h") + half("_h"))
    return pixels.join(size, "photo_id").filter(inside).drop("_w", "_h")


MASK_TILE = 64


def unmasked(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """pixels outside every mask(photo_id, bx, by, bw, bh) of their photo; a photo that is all masked stays whole.

    Pixels and masks meet in square tiles, so a photo's masks are held only against the pixels near them.
    """
    tile = lambda c: F.floor(c / MASK_TILE).cast("int")
    m = masks.select(F.col("photo_id").alias("_p"), "bx", "by", "bw", "bh", F.explode(F.sequence(tile(F.col("bx")), tile(F.col("bx") + F.col("bw")))).alias("_tx"))
    m = m.withColumn("_ty", F.explode(F.sequence(tile(F.col("by")), tile(F.col("by") + F.col("bh")))))
    inside = F.col("x").between(F.col("bx"), F.col("bx") + F.col("bw")) & F.col("y").between(F.col("by"), F.col("by") + F.col("bh"))
    kept = pixels.join(m, (F.col("photo_id") == F.col("_p")) & (tile(F.col("x")) == F.col("_tx")) & (tile(F.col("y")) == F.col("_ty")) & inside, "left_anti")
    whole = pixels.join(kept.select("photo_id").distinct(), "photo_id", "left_anti")
    return kept.unionByName(whole)


def dominant_colour(pixels: DataFrame) -> DataFrame:
    """photo_id, r, g, b: the most frequent colour in bins of 32 (bin centres); ties to the smallest."""
    bin_ = lambda c: (F.floor(F.col(c) / dims.COLOUR_BIN) * dims.COLOUR_BIN + dims.COLOUR_BIN // 2).cast("int").alias(c)
    counts = pixels.select("photo_id", bin_("r"), bin_("g"), bin_("b")).groupBy("photo_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("photo_id").agg(F.min(F.struct(-F.col("n"), "r", "g", "b")).alias("x"))
    return best.select("photo_id", "x.r", "x.g", "x.b")


def named_colours(colours: DataFrame) -> DataFrame:
    """colours(..., r, g, b) with colour: the nearest of sixteen names in CIE Lab, ties to the first listed."""
    p = dims.palette(colours.sparkSession)
    pl, pa, pb = lab(F.col("pr"), F.col("pg"), F.col("pb"))
    p = p.select("ord", "name", pl.alias("pl"), pa.alias("pa"), pb.alias("pbb"))
    seen = colours.select("r", "g", "b").distinct()
    l_, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    far = F.pow(l_ - F.col("pl"), 2) + F.pow(a - F.col("pa"), 2) + F.pow(b - F.col("pbb"), 2)
    best = seen.crossJoin(F.broadcast(p)).groupBy("r", "g", "b").agg(F.min(F.struct(far.alias("d"), "ord", "name")).alias("x"))  # 16 rows each
    return colours.join(best.select("r", "g", "b", F.col("x.name").alias("colour")), ["r", "g", "b"])


def colour_consensus(samples: DataFrame) -> DataFrame:
    """product_id, value, source, confidence, reason of samples(product_id, photo_id, colour): one name or none."""
    out = samples.groupBy("product_id").agg(F.count_distinct("colour").alias("n"), F.min("colour").alias("c"), F.array_join(F.array_sort(F.collect_set("colour")), ", ").alias("names"))
    return out.select("product_id", F.when(F.col("n") == 1, F.col("c")).alias("value"), F.lit("inferido").alias("source"), F.when(F.col("n") == 1, "media").otherwise("baja").alias("confidence"), F.when(F.col("n") == 1, "one colour in all samples").when(F.col("n") > 1, F.concat(F.lit("several colours: "), "names")).otherwise("no colour").alias("reason"))


def sharpness(grid: DataFrame) -> DataFrame:
    """photo_id, sharpness: population variance of the 4-neighbour Laplacian plus 128, clipped to 0..255.

    Border pixels, which lack a neighbour, keep their grey value, as the usual 3 x 3 image filters leave them.
    """
    across, down = W.partitionBy("photo_id", "y").orderBy("x"), W.partitionBy("photo_id", "x").orderBy("y")
    v = F.col("v")
    edge = F.lag("v").over(across) + F.lead("v").over(across) + F.lag("v").over(down) + F.lead("v").over(down) - 4 * v
    seen = F.when(F.col("e").isNull(), v).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.col("e") + 128)))  # least and greatest would take a null for nothing
    return grid.withColumn("e", edge).groupBy("photo_id").agg(F.var_pop(seen).alias("sharpness"))
