"""Resolving many noisy label readings into one value per field, with its provenance.

readings: product_id, seq, photo, box, legible, belongs, location, content, text, raw_ocr, origin. First-seen wins
everywhere, by seq, never by input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions import text as T
from listingops.functions.numbers import ean_valid
from listingops.sources import dims
from listingops.sources.stored import stored


def field_locations(spark) -> DataFrame:
    return spark.createDataFrame([(f, loc) for f, locs in dims.FIELD_LOCATIONS.items() for loc in locs], "field string, location string")


def legible(readings: DataFrame) -> DataFrame:
    """Readings that belong to the product and can be read."""
    return readings.filter(F.coalesce(F.col("belongs"), F.lit(False)) & F.coalesce(F.col("legible"), F.lit(False)) & T.blank_to_null(F.col("text")).isNotNull())


def checked_eans(readings: DataFrame) -> DataFrame:
    """Readings without EANs of a wrong check digit; kept EANs are digits only. Other content passes as it is."""
    ean = (F.col("content") == "ean") & F.col("text").isNotNull()
    digits = T.digits_only(F.col("text"))
    return readings.filter(~ean | ean_valid(digits) | ~F.coalesce(F.col("legible"), F.lit(False))).withColumn("text", F.when(ean, digits).otherwise(F.col("text")))


def resolve_fields(readings: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """product_id, field, value, source, confidence, photo, box, reason, alternatives of the four text fields.

    Several distinct values: none is chosen, all are alternatives (conflict). One value in a publishable place: it is
    taken at `media`, an EAN at `alta`. One value elsewhere: shown, not taken (only_elsewhere). No value: illegible
    where a publishable place was tried, else not_photographed. products adds products without readings.
    """
    spark = readings.sparkSession
    rows = checked_eans(readings).filter(F.coalesce(F.col("belongs"), F.lit(False)))
    places = F.broadcast(field_locations(spark).withColumn("publishable", F.lit(True)))
    rows = rows.withColumnRenamed("content", "field").filter(F.col("field").isin(*dims.FIELD_LOCATIONS)).join(places, ["field", "location"], "left").withColumn("publishable", F.coalesce("publishable", F.lit(False)))
    text = T.blank_to_null(F.col("text"))
    readable = F.coalesce(F.col("legible"), F.lit(False)) & text.isNotNull()
    norm = F.when(readable, F.lower(text))
    first = lambda cond: F.min(F.when(cond, F.struct("seq", "photo", "box", F.col("text").alias("text"), "location", "origin", "raw_ocr")))
    agg = rows.groupBy("product_id", "field").agg(
        F.count_distinct(norm).alias("n_values"),
        first(readable & F.col("publishable")).alias("best"),
        first(readable).alias("shown"),
        first(F.col("publishable")).alias("tried"),
        F.collect_list(F.when(readable, F.struct("seq", "text"))).alias("seen"),
    )
    asked = (products.select("product_id") if products is not None else readings.select("product_id")).distinct()
    every = asked.crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in dims.FIELD_LOCATIONS], "field string")))  # four rows each
    out = every.join(agg, ["product_id", "field"], "left")
    n = F.coalesce("n_values", F.lit(0))
    conflict, taken, tried = n > 1, (n == 1) & F.col("best").isNotNull(), F.col("tried").isNotNull()
    elsewhere = (n == 1) & F.col("best").isNull()
    reason = F.when(conflict, "conflict").when(taken, "single_value").when(elsewhere, "only_elsewhere").when(tried, "illegible").otherwise("not_photographed")
    source = F.when(taken | (~conflict & tried), "foto").otherwise("inferido")
    confidence = F.when(taken & (F.col("field") == "ean"), "alta").when(taken, "media").otherwise("baja")
    proof = F.when(taken, F.col("best")).when(~conflict & tried, F.col("tried"))
    ordered = F.transform(F.array_sort("seen"), lambda x: x["text"])
    firsts = F.aggregate(ordered, F.expr("CAST(array() AS array<string>)"), lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(F.trim(a)) == F.lower(F.trim(t))), acc).otherwise(F.concat(acc, F.array(t))))
    return out.select("product_id", "field", F.when(taken, F.col("best.text")).alias("value"), source.alias("source"), confidence.alias("confidence"), proof["photo"].alias("photo"), proof["box"].alias("box"), reason.alias("reason"), F.when(conflict, firsts).otherwise(F.expr("CAST(array() AS array<string>)")).alias("alternatives"), F.col("shown.text").alias("shown"))


def doubtful(readings: DataFrame) -> DataFrame:
    """product_id, seq, similarity of model readings whose raw OCR text, if it is a witness, does not resemble them."""
    rows = legible(readings).filter((F.col("origin") == "vlm") & T.is_witness(F.col("raw_ocr")))
    scored = rows.select("product_id", "seq", T.similarity(F.col("raw_ocr"), F.col("text")).alias("similarity"))
    return scored.filter(F.col("similarity") < dims.DOUBTFUL_SIMILARITY)


def marker_notes(readings: DataFrame) -> DataFrame:
    """product_id, value, photo, box, alternatives of notes after the defect marker: the first is the value, never joined."""
    noted = legible(readings).withColumn("note", T.marker_value(F.col("text"))).filter("note IS NOT NULL")
    out = noted.groupBy("product_id").agg(F.min(F.struct("seq", "note", "photo", "box")).alias("x"), F.array_sort(F.collect_list(F.struct("seq", "note"))).alias("all"))
    return out.select("product_id", F.col("x.note").alias("value"), "x.photo", "x.box", F.transform(F.slice("all", F.lit(2), F.size("all")), lambda a: a["note"]).alias("alternatives"))


def coherence(fields: DataFrame) -> DataFrame:
    """product_id, disjoint, files: identity fields with a value and a file; disjoint where two or more share no file.

    Each field has exactly one evidence file, so connected parts are distinct files.
    """
    own = fields.filter(F.col("field").isin(*dims.IDENTITY_FIELDS) & F.col("value").isNotNull() & F.col("photo").isNotNull())
    return own.groupBy("product_id").agg(((F.count(F.lit(1)) >= 2) & (F.count_distinct("photo") > 1)).alias("disjoint"), F.array_sort(F.collect_set("photo")).alias("files"))


def penalised(fields: DataFrame) -> DataFrame:
    """fields, with identity fields at alta lowered to media where the product's files are disjoint."""
    bad = coherence(fields).filter("disjoint").select("product_id", F.lit(True).alias("_bad"))
    rows = fields.join(bad, "product_id", "left")
    low = F.coalesce("_bad", F.lit(False)) & F.col("field").isin(*dims.IDENTITY_FIELDS) & (F.col("confidence") == "alta")
    return rows.withColumn("confidence", F.when(low, "media").otherwise(F.col("confidence"))).drop("_bad")


def checked_ean_field(fields: DataFrame) -> DataFrame:
    """fields, with an EAN of a wrong check digit made null at baja; source and evidence stay."""
    bad = (F.col("field") == "ean") & F.col("value").isNotNull() & ~ean_valid(T.digits_only(F.col("value")))
    return fields.withColumn("confidence", F.when(bad, "baja").otherwise(F.col("confidence"))).withColumn("value", F.when(bad, F.lit(None)).otherwise(F.col("value")))


def resolve(readings: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """resolve_fields with the EAN check and the coherence penalty: the whole deterministic part."""
    return penalised(checked_ean_field(resolve_fields(readings, products)))


# -- regions ---------------------------------------------------------------------------------------------------------


def plan_regions(regions: DataFrame) -> DataFrame:
    """regions(product_id, photo, photo_seq, region_seq, x, y, w, h, text, score) with plan: ruler, shortcut, long,
    repeat or read; content and value of a shortcut.

    Order matters: ruler tape first, then OCR shortcuts, then long blocks; a region that holds an EAN or model already
    found in this or an earlier photo of the product is a repeat.
    """
    hit = T.ocr_shortcut(F.col("text"), F.col("score"))
    rows = regions.withColumn("_hit", hit)
    plan = F.when(T.is_ruler_text(F.col("text")), "ruler").when(F.col("_hit").isNotNull(), "shortcut").when(T.is_long_block(F.col("text")), "long").otherwise("read")
    rows = rows.withColumn("plan", plan).withColumn("content", F.when(F.col("plan") == "shortcut", F.col("_hit.content"))).withColumn("value", F.when(F.col("plan") == "shortcut", F.col("_hit.value"))).drop("_hit")
    known = rows.filter("plan = 'shortcut'").groupBy("product_id", "value").agg(F.min("photo_seq").alias("from_seq"))
    known = known.select(F.col("product_id").alias("_p"), F.col("value").alias("_v"), "from_seq")
    open_rows = rows.filter("plan = 'read'")
    fresh = open_rows.join(known, (F.col("product_id") == F.col("_p")) & F.col("text").contains(F.col("_v")) & (F.col("from_seq") <= F.col("photo_seq")), "left_anti")
    repeat = open_rows.join(known, (F.col("product_id") == F.col("_p")) & F.col("text").contains(F.col("_v")) & (F.col("from_seq") <= F.col("photo_seq")), "left_semi")
    return rows.filter("plan <> 'read'").unionByName(fresh).unionByName(repeat.withColumn("plan", F.lit("repeat")))


def pooled_readings(readings: DataFrame, planned: DataFrame) -> DataFrame:
    """readings with those that OCR alone gives: the shortcuts of plan_regions, as legible readings of a printed code.

    They come after the model's readings of a product, in the order of photo and region; a product that only has
    shortcuts gets these alone.
    """
    last = readings.groupBy("product_id").agg(F.max("seq").alias("_last"))
    w = W.partitionBy("product_id").orderBy("photo_seq", "region_seq")
    own = planned.filter("plan = 'shortcut'").join(last, "product_id", "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).cast("long"))
    box = F.struct(*(F.col(c).cast("int").alias(c) for c in "xywh"))
    rows = own.select("product_id", "seq", "photo", box.alias("box"), F.lit(True).alias("legible"), F.lit(True).alias("belongs"), F.lit("codigo_o_modelo_impreso").alias("location"), "content", F.col("value").alias("text"), F.col("text").alias("raw_ocr"), F.lit("ocr").alias("origin"))
    return readings.select(*rows.columns).unionByName(rows)


TILE_W, TILE_H = -dims.NEAR_OVERLAP_X, dims.NEAR_GAP_Y  # two boxes that touch one tile are near, two tiles apart never


def _tiled(regions: DataFrame, wider: int = 0, higher: int = 0) -> DataFrame:
    """regions with tx, ty of each tile that the box touches, made wider and higher on either side by so much."""
    tiles = lambda low, high, size: F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))
    rows = regions.withColumn("tx", F.explode(tiles(F.col("x") - wider, F.col("x") + F.col("w") + wider, TILE_W)))
    return rows.withColumn("ty", F.explode(tiles(F.col("y") - higher, F.col("y") + F.col("h") + higher, TILE_H)))


def near_regions(regions: DataFrame) -> DataFrame:
    """product_id, photo, a, b (region_seq, a < b) of boxes of one photo with a small vertical gap and enough overlap.

    Boxes, wider and higher by half of what may lie between near ones, meet in the tiles that both touch, and are
    compared in the one that holds the corner of their common part. A photo may hold any number of boxes.
    """
    rows = _tiled(regions, TILE_W // 2, TILE_H // 2)
    x, y = rows.alias("x"), rows.alias("y")
    gap = F.greatest(F.col("x.y"), F.col("y.y")) - F.least(F.col("x.y") + F.col("x.h"), F.col("y.y") + F.col("y.h"))
    over = F.least(F.col("x.x") + F.col("x.w"), F.col("y.x") + F.col("y.w")) - F.greatest(F.col("x.x"), F.col("y.x"))
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("product_id", "photo", "tx", "ty")]
    here = (F.floor((F.greatest("x.x", "y.x") - TILE_W // 2) / TILE_W) == F.col("x.tx")) & (F.floor((F.greatest("x.y", "y.y") - TILE_H // 2) / TILE_H) == F.col("x.ty"))
    same = meet[0] & meet[1] & meet[2] & meet[3] & here & (F.col("x.region_seq") < F.col("y.region_seq"))
    return x.join(y, same & (gap <= dims.NEAR_GAP_Y) & (over > dims.NEAR_OVERLAP_X)).select("x.product_id", "x.photo", F.col("x.region_seq").alias("a"), F.col("y.region_seq").alias("b"))


def cluster_links(regions: DataFrame) -> DataFrame:
    """product_id, photo, a, b: near boxes of one photo whose links connect all that nearness connects.

    All boxes that touch a tile are near each other and are linked to the least of them. Of two tiles side by side only
    the boxes that reach out most towards each other are compared; of two that meet at a corner, those that end inside,
    one for each row of pixels. So links grow with the boxes, not with the pairs.
    """
    keys = ["product_id", "photo", "tx", "ty"]
    rows = _tiled(regions).withColumn("right", F.col("x") + F.col("w")).withColumn("bottom", F.col("y") + F.col("h"))
    hub = lambda *order: F.struct(*order, F.col("region_seq"))
    tiles = rows.groupBy(*keys).agg(
        F.min("region_seq").alias("hub"), F.max(hub("right"))["region_seq"].alias("rightmost"), F.max("right").alias("right"), F.min(hub("x"))["region_seq"].alias("leftmost"), F.min("x").alias("left"),
        F.max(hub("bottom"))["region_seq"].alias("lowest"), F.max("bottom").alias("bottom"), F.min(hub("y"))["region_seq"].alias("highest"), F.min("y").alias("top"),
    )
    stars = rows.join(tiles.select(*keys, "hub"), keys).filter("region_seq <> hub").select("product_id", "photo", F.col("hub").alias("a"), F.col("region_seq").alias("b"))

    def shifted(df: DataFrame, dx: int, dy: int) -> DataFrame:  # so that a tile meets the one dx, dy further
        return df.withColumn("tx", F.col("tx") - dx).withColumn("ty", F.col("ty") - dy)

    beside = tiles.join(shifted(tiles.select(*keys, F.col("leftmost").alias("b"), F.col("left").alias("from")), 1, 0), keys).filter(F.col("from") - F.col("right") < TILE_W).select("product_id", "photo", F.col("rightmost").alias("a"), "b")
    under = tiles.join(shifted(tiles.select(*keys, F.col("highest").alias("b"), F.col("top").alias("from")), 0, 1), keys).filter(F.col("from") - F.col("bottom") <= TILE_H).select("product_id", "photo", F.col("lowest").alias("a"), "b")
    ends = F.floor(F.col("right") / TILE_W) == F.col("tx")
    starts = F.floor(F.col("x") / TILE_W) == F.col("tx")

    def edge(inside: Column, row: str, best: Column) -> DataFrame:  # of the boxes that end in a tile, the best of each pixel row
        return rows.filter(inside).groupBy(*keys, F.col(row).alias("row")).agg(best.alias("e"))

    low_a = edge(ends & (F.floor(F.col("bottom") / TILE_H) == F.col("ty")), "bottom", F.max(hub("right")))
    high_b = edge(starts & (F.floor(F.col("y") / TILE_H) == F.col("ty")), "y", F.min(hub("x")))
    high_a = edge(ends & (F.floor(F.col("y") / TILE_H) == F.col("ty")), "y", F.max(hub("right")))
    low_b = edge(starts & (F.floor(F.col("bottom") / TILE_H) == F.col("ty")), "bottom", F.min(hub("x")))

    def corner(a: DataFrame, b: DataFrame, dy: int) -> DataFrame:
        other = shifted(b.select(*keys, F.col("row").alias("_row"), F.col("e").alias("_e")), 1, dy)
        gap = (F.col("_row") - F.col("row")) * dy
        return a.join(other, keys).filter((F.col("_e.x") - F.col("e.right") < TILE_W) & (gap <= TILE_H)).select("product_id", "photo", F.col("e.region_seq").alias("a"), F.col("_e.region_seq").alias("b"))

    return stars.union(beside).union(under).union(corner(low_a, high_b, 1)).union(corner(high_a, low_b, -1)).filter("a <> b").distinct()


def region_clusters(regions: DataFrame, most_rounds: int = 60) -> DataFrame:
    """regions with cluster: the least region_seq that nearness reaches within its photo.

    Boxes of several photos are labelled at once: each round every box takes the least label of its neighbours, and then
    that label's own, until no label changes. Each round is a stored table. Raises after most_rounds, far more than
    halving leaves of any chain.
    """
    keys = ["product_id", "photo"]
    links = cluster_links(regions)
    links = stored(links.union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "region-links")
    labels = links.select(*keys, F.col("a").alias("region_seq")).distinct().withColumn("cluster", F.col("region_seq")).withColumn("moved", F.lit(True))
    for _ in range(most_rounds):
        own = labels.select(*keys, F.col("region_seq").alias("a"), F.col("cluster").alias("_c"))
        near = links.join(own, [*keys, "a"]).groupBy(*keys, F.col("b").alias("region_seq")).agg(F.min("_c").alias("_near"))
        taken = labels.join(near, [*keys, "region_seq"]).select(*keys, "region_seq", "cluster", F.least("cluster", "_near").alias("_c"))
        over = taken.select(*keys, F.col("region_seq").alias("_c"), F.col("_c").alias("_further"))
        step = taken.join(over, [*keys, "_c"], "left").withColumn("_new", F.least("_c", F.coalesce("_further", "_c")))
        labels = stored(step.select(*keys, "region_seq", F.col("_new").alias("cluster"), (F.col("_new") < F.col("cluster")).alias("moved")), "region-labels")
        if labels.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"region clusters did not settle in {most_rounds} rounds")
    return regions.join(labels.drop("moved"), [*keys, "region_seq"], "left").withColumn("cluster", F.coalesce("cluster", "region_seq"))


def merged_regions(clustered: DataFrame) -> DataFrame:
    """One region for each cluster: the union box, the least score, the texts from top to bottom."""
    rows = clustered.groupBy("product_id", "photo", "photo_seq", "cluster").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.min("score").alias("score"), F.array_sort(F.collect_list(F.struct("y", "region_seq", "text"))).alias("_t"))
    return rows.select("product_id", "photo", "photo_seq", F.col("cluster").alias("region_seq"), "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), F.array_join(F.transform("_t", lambda a: a["text"]), " ").alias("text"), "score")


def capped_requests(regions: DataFrame, most: int = dims.MAX_REQUESTS) -> DataFrame:
    """regions with request_no, kept (up to `most` of a product) and overflow (how many more it has)."""
    w = W.partitionBy("product_id")
    rows = regions.withColumn("request_no", F.row_number().over(w.orderBy("photo_seq", "region_seq")))
    return rows.withColumn("kept", F.col("request_no") <= most).withColumn("overflow", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - most))


# -- gap filling by a model's synthesis ------------------------------------------------------------------------------


def fill_gaps(fields: DataFrame, synthesis: DataFrame, readings: DataFrame) -> DataFrame:
    """fields with the null ones of marca, talla, modelo and color filled from
    synthesis(product_id, field, value, visible, cited_text, confidence).

    A value counts as seen only where it is visible, cites a legible reading in a publishable place and stands in that
    reading as whole tokens; else it is inferido at baja.
    """
    w = W.partitionBy("product_id", "_t").orderBy("seq")
    cited = legible(readings).withColumn("_t", F.lower(F.trim("text"))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("product_id", "_t", F.col("text").alias("_text"), F.col("location").alias("_loc"), F.col("photo").alias("_photo"), F.col("box").alias("_box"))
    said = synthesis.filter(T.blank_to_null(F.col("value")).isNotNull() & F.col("field").isin("marca", "talla", "modelo", "color")).withColumn("_t", F.lower(F.trim("cited_text")))
    said = said.join(cited, ["product_id", "_t"], "left")
    places = F.broadcast(field_locations(fields.sparkSession).select(F.col("field"), F.col("location").alias("_loc"), F.lit(True).alias("_ok")))
    said = said.join(places, ["field", "_loc"], "left")
    seen = F.col("visible") & (F.coalesce("_ok", F.lit(False)) | (F.col("field") == "color")) & T.has_token(F.col("_text"), F.col("value"))
    said = said.withColumn("_seen", F.coalesce(seen, F.lit(False))).select("product_id", "field", F.trim("value").alias("_value"), "_seen", F.col("confidence").alias("_conf"), "_photo", "_box")
    rows = fields.join(said, ["product_id", "field"], "left")
    fill = F.col("value").isNull() & F.col("_value").isNotNull()
    pick = lambda new, old: F.when(fill, new).otherwise(F.col(old)).alias(old)
    return rows.select("product_id", "field", pick(F.col("_value"), "value"), pick(F.when(F.col("_seen"), "foto").otherwise("inferido"), "source"), pick(F.when(F.col("_seen"), F.col("_conf")).otherwise("baja"), "confidence"), pick(F.when(F.col("_seen"), F.col("_photo")), "photo"), pick(F.when(F.col("_seen"), F.col("_box")), "box"), pick(F.when(F.col("_seen"), "synthesis_seen").otherwise("synthesis_inferred"), "reason"))


def judged_codes(synthesis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failures) of the judgement fields: categoria must be known, genero may be null, estado one of the six
    choices, tipo is free. Failures carry the offending text."""
    own = synthesis.filter(F.col("field").isin("categoria", "genero", "estado", "tipo")).withColumn("value", T.blank_to_null(F.col("value")))
    ok = (
        F.when(F.col("field") == "categoria", F.coalesce(F.col("value").isin(*dims.CATEGORIES), F.lit(False)))
        .when(F.col("field") == "genero", F.col("value").isNull() | F.col("value").isin(*dims.GENDERS))
        .when(F.col("field") == "estado", F.col("value").isNull() | F.col("value").isin(*dims.CHOICES))
        .otherwise(F.lit(True))
    )
    rows = own.withColumn("_ok", ok)
    conf = F.when(F.col("confidence").isin("media", "baja"), F.col("confidence")).otherwise("baja")
    valid = rows.filter("_ok").select("product_id", "field", "value", F.lit("inferido").alias("source"), conf.alias("confidence"))
    return valid, rows.filter("NOT _ok").select("product_id", "field", F.concat(F.lit("vlm_sintesis: "), "field", F.lit(" not valid: "), F.coalesce("value", F.lit("null"))).alias("failure"))


def measures(attempts: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """product_id, value, reason of attempts(product_id, seq, zero_visible, edge_visible, value): the first photo with
    both ends in sight gives the value. With products, those without any photo of a ruler are not_photographed."""
    ends = F.coalesce(F.col("zero_visible") & F.col("edge_visible") & F.col("value").isNotNull(), F.lit(False))
    out = attempts.groupBy("product_id").agg(F.min(F.when(ends, F.struct("seq", "value"))).alias("x"), F.lit(True).alias("tried"))
    if products is not None:
        out = products.select("product_id").join(out, "product_id", "left")
    reason = F.when(F.col("x").isNotNull(), "measured").when(F.col("tried"), "illegible").otherwise("not_photographed")
    return out.select("product_id", F.col("x.value").alias("value"), reason.alias("reason"))


def name_collisions(photos: DataFrame) -> DataFrame:
    """product_id, base_name, n of base names that two or more paths of one product share."""
    base = F.regexp_extract("path", r"([^/\\]+)$", 1)
    return photos.groupBy("product_id", base.alias("base_name")).agg(F.count_distinct("path").alias("n")).filter("n > 1")


def candidate_lines(readings: DataFrame) -> DataFrame:
    """product_id, lines: location, content and text of legible readings, each once, in order."""
    line = F.concat_ws(" | ", "location", "content", F.trim("text"))
    rows = legible(readings).groupBy("product_id", line.alias("line")).agg(F.min("seq").alias("seq"))
    return rows.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("lines"))
