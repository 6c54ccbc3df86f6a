"""Scoring against golden sets: group fusions and over-cuts, threshold sweeps, and extraction cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions.numbers import seconds_between
from listingops.functions.text import compared


def group_errors(groups: DataFrame, by: list[str]) -> DataFrame:
    """by..., n_groups, fusions, over_cuts of groups(by..., group_id, photo_id, true_id).

    A fusion is a group that mixes true products; over-cuts are the groups a true product touches beyond one.
    """
    fused = groups.groupBy(*by, "group_id").agg(F.count_distinct("true_id").alias("n")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("fusions"))
    cut = groups.groupBy(*by, "true_id").agg(F.count_distinct("group_id").alias("n")).groupBy(*by).agg(F.sum(F.col("n") - 1).alias("over_cuts"))
    return fused.join(cut, by)


def sweep(photos: DataFrame, thresholds: DataFrame) -> DataFrame:
    """threshold_s, n_groups, fusions, over_cuts of photos(lot_id, photo_id, captured_at, true_id) for each threshold.

    thresholds is a list of candidates, no more than a few dozen; gaps are computed once and reused for each.
    """
    order = W.partitionBy("lot_id").orderBy("captured_at", "photo_id")
    gap = photos.withColumn("gap_s", seconds_between(F.lag("captured_at").over(order), F.col("captured_at")))
    every = gap.crossJoin(F.broadcast(thresholds.select(F.col("threshold_s").cast("double").alias("threshold_s"))))
    run = W.partitionBy("lot_id", "threshold_s").orderBy("captured_at", "photo_id").rowsBetween(W.unboundedPreceding, 0)
    cut = F.sum(F.coalesce((F.col("gap_s") >= F.col("threshold_s")).cast("int"), F.lit(0))).over(run)
    return group_errors(every.withColumn("group_id", F.concat_ws("/", F.col("lot_id").cast("string"), cut.cast("string"))), ["threshold_s"])


def safe_zone(swept: DataFrame) -> DataFrame:
    """safe_max (largest threshold below the first fusion), cliff (that fusion's threshold), margin_s."""
    cliff = swept.agg(F.min(F.when(F.col("fusions") > 0, F.col("threshold_s"))).alias("cliff"))
    safe = swept.crossJoin(F.broadcast(cliff)).filter("cliff IS NULL OR threshold_s < cliff").agg(F.max("threshold_s").alias("safe_max"), F.max("cliff").alias("cliff"))
    return safe.select("safe_max", "cliff", (F.col("cliff") - F.col("safe_max")).alias("margin_s"))


def classify_cells(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """product, field, label, class of every truth cell.

    truth: product, field, label, legible_value, candidates. predicted: product, field, value, confidence, alternatives,
    readings, has_crop. A cell without a prediction counts as one that proposes nothing.
    """
    cells = truth.join(predicted, ["product", "field"], "left")
    none = F.expr("CAST(array() AS array<string>)")
    norm = lambda a: F.transform(F.coalesce(a, none), compared)
    given, true = compared(F.col("value")), compared(F.col("legible_value"))
    alts, reads, wanted = norm(F.col("alternatives")), norm(F.col("readings")), norm(F.col("candidates"))
    legible = F.col("label").isin("LEGIBLE_TEXTO", "LEGIBLE_VISUAL")
    high = F.coalesce(F.col("confidence") == "alta", F.lit(False))
    out = (
        F.when(~legible & given.isNull(), "abstain_ok")
        .when(~legible & high, "hallucination_high")
        .when(~legible, "hallucination")
        .when((F.size(wanted) > 1) & given.isNull() & (F.size(F.array_intersect(alts, wanted)) > 1), "conflict_ok")
        .when((F.size(wanted) > 1) & given.isNotNull() & ~F.array_contains(wanted, given), "wrong")
        .when(given.isNotNull() & (given == true), "hit")
        .when(given.isNotNull(), "misread")
        .when(F.array_contains(F.concat(alts, reads), true), "in_readings")
        .when(F.coalesce("has_crop", F.lit(False)), "crop_only")
        .otherwise("lost")
    )
    return cells.select("product", "field", "label", out.alias("class"))


def cell_rates(classified: DataFrame) -> DataFrame:
    """n, hits, hallucinations, hallucinations_high, hallucination_rate, coverage: one row.

    coverage is the share of legible cells that are published, in conflict, in readings or at least shown as a crop.
    """
    legible = F.col("label").isin("LEGIBLE_TEXTO", "LEGIBLE_VISUAL")
    shown = F.col("class").isin("hit", "conflict_ok", "in_readings", "crop_only")
    bad = F.col("class").isin("hallucination", "hallucination_high")
    out = classified.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == "hit").alias("hits"), F.count_if(bad).alias("hallucinations"), F.count_if(F.col("class") == "hallucination_high").alias("hallucinations_high"), F.count_if(~legible).alias("_off"), F.count_if(legible).alias("_on"), F.count_if(legible & shown).alias("_shown"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("n", "hits", "hallucinations", "hallucinations_high", rate("hallucinations", "_off").alias("hallucination_rate"), rate("_shown", "_on").alias("coverage"))


def label_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
