"""Splitting photo lots into products by gaps in capture time, seams between neighbours, and proposals.

photos: lot_id, photo_id, name, captured_at, readable, read_error. All work is windows over a lot; a lot is one batch of
photos, so a window's partition stays as large as one upload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions.numbers import seconds_between
from listingops.operators.dealing import dealt
from listingops.sources import dims


def seam_sections(photos: DataFrame) -> DataFrame:
    """photos with section: dated, undated or unreadable. Every photo is in one section."""
    readable = F.coalesce(F.col("readable"), F.lit(False))
    return photos.withColumn("section", F.when(~readable, "unreadable").when(F.col("captured_at").isNull(), "undated").otherwise("dated"))


def gaps(photos: DataFrame) -> DataFrame:
    """Dated photos with gap_s to the one before in their lot, by time, then name."""
    w = W.partitionBy("lot_id").orderBy("captured_at", "name", "photo_id")
    return photos.withColumn("gap_s", seconds_between(F.lag("captured_at").over(w), F.col("captured_at")))


def grouped_photos(photos: DataFrame, gap_s: float = dims.GAP_SECONDS) -> DataFrame:
    """photos with section, group_key, clock: a gap of gap_s or more cuts.

    clock says why a lot's times are not trusted: `single` with one dated photo, `same_time` where all dated photos
    have one instant (then each stands alone); else `ok`. Undated and unreadable photos stand alone.
    """
    parts = seam_sections(photos)
    dated = gaps(parts.filter("section = 'dated'"))
    lot = W.partitionBy("lot_id")
    order = lot.orderBy("captured_at", "name", "photo_id").rowsBetween(W.unboundedPreceding, 0)
    cut = F.coalesce((F.col("gap_s") >= gap_s).cast("int"), F.lit(0))
    n, most = F.count(F.lit(1)).over(lot), F.max("gap_s").over(lot)
    clock = F.when(n == 1, "single").when(most == 0, "same_time").otherwise("ok")
    run = F.sum(cut).over(order)
    dated = dated.withColumn("clock", clock).withColumn("run", run)
    key = F.when(F.col("clock") == "same_time", F.concat(F.lit("p:"), F.col("photo_id").cast("string"))).otherwise(F.concat(F.lit("g:"), F.col("run").cast("string")))
    dated = dated.withColumn("group_key", key).withColumn("gap_s", F.when(cut == 0, F.col("gap_s"))).drop("run")
    alone = parts.filter("section <> 'dated'").withColumn("gap_s", F.lit(None).cast("double")).withColumn("clock", F.lit("none")).withColumn("group_key", F.concat(F.lit("p:"), F.col("photo_id").cast("string")))
    return dated.unionByName(alone)


def group_photos(photos: DataFrame, gap_s: float = dims.GAP_SECONDS) -> DataFrame:
    """One row for each proposed group: lot_id, section, group_key, members, size, started_at, ended_at, duration_s,
    largest_gap_s, confidence, reason_code, reason, emit_order.

    Confidence is media for a group of several by time, baja otherwise, never alta. Groups of a lot come in the order
    dated, undated, unreadable.
    """
    rows = grouped_photos(photos, gap_s)
    out = rows.groupBy("lot_id", "section", "group_key", "clock").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("captured_at", "name", "photo_id"))), lambda x: x["photo_id"]).alias("members"),
        F.count(F.lit(1)).alias("size"),
        F.min("captured_at").alias("started_at"),
        F.max("captured_at").alias("ended_at"),
        F.max("gap_s").alias("largest_gap_s"),
        F.min("name").alias("first_name"),
        F.min("read_error").alias("read_error"),
    )
    out = out.withColumn("duration_s", seconds_between(F.col("started_at"), F.col("ended_at")))
    several = (F.col("section") == "dated") & (F.col("size") > 1)
    code = (
        F.when(F.col("section") == "unreadable", "unreadable").when(F.col("section") == "undated", "undated")
        .when(F.col("clock") == "same_time", "same_time").when(F.col("clock") == "single", "single_dated")
        .when(F.col("size") == 1, "single").otherwise("burst")
    )
    out = out.withColumn("confidence", F.when(several, "media").otherwise("baja")).withColumn("reason_code", code)
    rank = F.when(F.col("section") == "dated", 0).when(F.col("section") == "undated", 1).otherwise(2)
    w = W.partitionBy("lot_id").orderBy(rank, F.col("started_at").asc_nulls_first(), "first_name", "group_key")
    return out.withColumn("reason", reason_text(gap_s)).withColumn("emit_order", F.row_number().over(w)).drop("clock", "first_name", "read_error")


def reason_text(gap_s: float) -> Column:
    """A sentence for the reviewer with the group's own numbers."""
    burst = F.format_string("%d photos in %.0f s, largest gap %.0f s, cut at %.0f s", F.col("size"), F.col("duration_s"), F.coalesce("largest_gap_s", F.lit(0.0)), F.lit(float(gap_s)))
    return (
        F.when(F.col("reason_code") == "burst", burst)
        .when(F.col("reason_code") == "single", F.lit("one photo between two gaps"))
        .when(F.col("reason_code") == "single_dated", F.lit("the only dated photo of the lot"))
        .when(F.col("reason_code") == "same_time", F.lit("all dated photos have the same time"))
        .when(F.col("reason_code") == "undated", F.lit("no capture time"))
        .otherwise(F.concat(F.lit("unreadable: "), F.coalesce("read_error", F.lit("no detail"))))
    )


def long_pauses(groups: DataFrame, pause_s: float = dims.LONG_PAUSE_SECONDS) -> DataFrame:
    """groups with pause_s to the next group of the lot and long_pause; both null where either side is undated."""
    w = W.partitionBy("lot_id").orderBy("emit_order")
    pause = seconds_between(F.col("ended_at"), F.lead("started_at").over(w))
    return groups.withColumn("pause_s", pause).withColumn("long_pause", F.col("pause_s") >= pause_s)


def partition_by_seams(order: DataFrame, open_seams: DataFrame) -> DataFrame:
    """order(lot_id, photo_id, pos) with part: the run number between open seams (lot_id, left_id, right_id)."""
    w = W.partitionBy("lot_id").orderBy("pos")
    seams = open_seams.select("lot_id", F.col("left_id").alias("_l"), F.col("right_id").alias("photo_id"), F.lit(1).alias("_cut")).dropDuplicates()
    near = order.withColumn("_l", F.lag("photo_id").over(w))
    cut = near.join(seams, ["lot_id", "_l", "photo_id"], "left")
    return cut.withColumn("part", F.sum(F.coalesce("_cut", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))).select(*order.columns, "part")


def open_seams_of(assignment: DataFrame) -> DataFrame:
    """lot_id, left_id, right_id: neighbours of assignment(lot_id, photo_id, pos, product_id) in different products.

    A neighbour without a product always cuts, also beside another one without.
    """
    w = W.partitionBy("lot_id").orderBy("pos")
    near = assignment.withColumn("right_id", F.lead("photo_id").over(w)).withColumn("_p", F.lead("product_id").over(w))
    same = F.coalesce(F.col("product_id") == F.col("_p"), F.lit(False))
    return near.filter(F.col("right_id").isNotNull() & ~same).select("lot_id", F.col("photo_id").alias("left_id"), "right_id")


def edited_seams(open_seams: DataFrame, commands: DataFrame) -> DataFrame:
    """The open seams after a log of commands(lot_id, left_id, right_id, seq, action): open splits a pair, close merges it.

    The last command on a pair wins, by seq; of two with one seq, open. A pair without a command stays as it is.
    """
    keys = ["lot_id", "left_id", "right_id"]
    log = open_seams.select(*keys, F.lit(None).cast("long").alias("seq"), F.lit(True).alias("open")).union(commands.select(*keys, F.col("seq").cast("long"), F.col("action") == "open"))
    return log.groupBy(*keys).agg(F.max(F.struct("seq", "open")).alias("x")).filter("x.open").select(*keys)


def manually_merged(assignment: DataFrame, proposed_open: DataFrame) -> DataFrame:
    """lot_id, product_id of saved groups that hold a neighbouring pair which the proposal leaves open."""
    w = W.partitionBy("lot_id").orderBy("pos")
    near = assignment.withColumn("right_id", F.lead("photo_id").over(w)).withColumn("_p", F.lead("product_id").over(w))
    inside = near.filter(F.col("product_id") == F.col("_p")).withColumnRenamed("photo_id", "left_id")
    return inside.join(proposed_open, ["lot_id", "left_id", "right_id"], "left_semi").select("lot_id", "product_id").distinct()


def proposal_violations(proposal: DataFrame, photos: DataFrame) -> DataFrame:
    """lot_id, rule, item of a proposal(lot_id, group_id, photo_id) that may not be saved.

    photos: lot_id, photo_id, readable, confirmed. Rules: empty_group (a null photo), photo_twice, unknown_photo,
    confirmed_photo, unreadable_mixed.
    """
    empty = proposal.filter("photo_id IS NULL").select("lot_id", F.lit("empty_group").alias("rule"), F.col("group_id").cast("string").alias("item"))
    twice = proposal.filter("photo_id IS NOT NULL").groupBy("lot_id", "photo_id").agg(F.count_distinct("group_id").alias("n")).filter("n > 1").select("lot_id", F.lit("photo_twice").alias("rule"), F.col("photo_id").cast("string").alias("item"))
    known = proposal.filter("photo_id IS NOT NULL").join(photos.select("lot_id", "photo_id", "readable", "confirmed"), ["lot_id", "photo_id"], "left")
    unknown = known.filter("readable IS NULL").select("lot_id", F.lit("unknown_photo").alias("rule"), F.col("photo_id").cast("string").alias("item"))
    confirmed = known.filter("confirmed").select("lot_id", F.lit("confirmed_photo").alias("rule"), F.col("photo_id").cast("string").alias("item"))
    mixed = known.filter("readable IS NOT NULL").groupBy("lot_id", "group_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("readable")).alias("bad")).filter("bad > 0 AND n > 1")
    mixed = mixed.select("lot_id", F.lit("unreadable_mixed").alias("rule"), F.col("group_id").cast("string").alias("item"))
    return empty.union(twice).union(unknown).union(confirmed).union(mixed).distinct()


def accepted_proposals(proposal: DataFrame, photos: DataFrame) -> DataFrame:
    """The proposals of lots without any violation."""
    return proposal.join(proposal_violations(proposal, photos).select("lot_id").distinct(), "lot_id", "left_anti")


def saved_assignment(current: DataFrame, proposal: DataFrame) -> DataFrame:
    """lot_id, photo_id, product_id, confirmed after saving a proposal(lot_id, photo_id, product_id): confirmed rows of
    current stay, unconfirmed ones of the proposal's lots are replaced."""
    kept = current.filter("confirmed").unionByName(dealt(current.filter("NOT confirmed"), "lot_id").join(proposal.select("lot_id").distinct(), "lot_id", "left_anti"))
    new = dealt(proposal, "lot_id", "photo_id").join(kept.select("lot_id", "photo_id"), ["lot_id", "photo_id"], "left_anti").withColumn("confirmed", F.lit(False))
    return kept.select("lot_id", "photo_id", "product_id", "confirmed").unionByName(new.select("lot_id", "photo_id", "product_id", "confirmed"))


def initial_proposal(photos: DataFrame, gap_s: float = dims.GAP_SECONDS) -> DataFrame:
    """lot_id, photo_id, product_id: photos with a product keep it, the others get their proposed group's key."""
    held = photos.filter("product_id IS NOT NULL").select("lot_id", "photo_id", F.col("product_id").cast("string").alias("product_id"))
    free = grouped_photos(photos.filter("product_id IS NULL"), gap_s).select("lot_id", "photo_id", F.concat_ws("/", F.col("lot_id").cast("string"), "group_key").alias("product_id"))
    return held.unionByName(free)


def complete_proposal(edited: DataFrame, photos: DataFrame) -> DataFrame:
    """edited(lot_id, group_id, photo_id) with every unreadable photo that it lacks in a group of its own."""
    missing = photos.filter(~F.col("readable")).join(edited, ["lot_id", "photo_id"], "left_anti")
    return edited.unionByName(missing.select("lot_id", F.concat(F.lit("p:"), F.col("photo_id").cast("string")).alias("group_id"), "photo_id"))


def curation_order(photos: DataFrame) -> DataFrame:
    """photos with pos: undated first, then by time, then name."""
    w = W.partitionBy("lot_id").orderBy(F.col("captured_at").asc_nulls_first(), "name", "photo_id")
    return photos.withColumn("pos", F.row_number().over(w))


def rhythm(photos: DataFrame) -> DataFrame:
    """lot_id, n_dated, p10..p90, least, most, jitter_s, verdict of a lot's gaps; null figures under three dated photos.

    Quantiles are the lower nearest rank floor(q (n - 1)); jitter is the sample deviation of gaps up to the median.
    """
    g = gaps(photos.filter("captured_at IS NOT NULL")).filter("gap_s IS NOT NULL")
    w = W.partitionBy("lot_id")
    ranked = g.withColumn("i", F.row_number().over(w.orderBy("gap_s", "photo_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("median", F.median("gap_s").over(w))
    at = lambda q: F.max(F.when(F.col("i") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col("gap_s")))
    short = F.when(F.col("gap_s") <= F.col("median"), F.col("gap_s"))
    out = ranked.groupBy("lot_id").agg((F.count(F.lit(1)) + 1).alias("n_dated"), at(0.10).alias("p10"), at(0.25).alias("p25"), at(0.50).alias("p50"), at(0.75).alias("p75"), at(0.90).alias("p90"), F.min("gap_s").alias("least"), F.max("gap_s").alias("most"), F.stddev_samp(short).alias("jitter_s"))
    verdict = F.when(F.col("jitter_s") <= 1.5, "regular").when(F.col("jitter_s") <= 2.5, "irregular").when(F.col("jitter_s").isNotNull(), "very_irregular")
    enough = F.col("n_dated") >= 3
    return out.select("lot_id", "n_dated", *(F.when(enough, F.col(c)).alias(c) for c in ("p10", "p25", "p50", "p75", "p90", "least", "most", "jitter_s"))).withColumn("verdict", verdict)
