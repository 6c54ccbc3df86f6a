"""Queries of upkeep: measures, judged codes, labels, missing and colliding files, unknown targets, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.operators import evals, ledger, listings, ordering, readings
from listingops.plans.registry import query
from listingops.plans.sales_queries import EVENTS, LOTS, _lots, _state
from listingops.sources import derived, dims


@query(f"""
WITH a AS (SELECT l_partkey AS product_id, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(derived.LINE_ORDER)}) AS seq, l_quantity > 30 AS zero_visible, l_discount > 0.05 AS edge_visible, CASE WHEN l_tax > 0.02 THEN l_quantity END AS value FROM lineitem WHERE l_partkey % 9 <> 0),
m AS (SELECT product_id, arg_min(value, seq) FILTER (zero_visible AND edge_visible AND value IS NOT NULL) AS value FROM a GROUP BY product_id)
SELECT p_partkey AS product_id, value, CASE WHEN value IS NOT NULL THEN 'measured' WHEN m.product_id IS NOT NULL THEN 'illegible' ELSE 'not_photographed' END AS reason FROM part LEFT JOIN m ON p_partkey = m.product_id
""")
def measured_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every part from line items as photos of a ruler; every ninth part has none."""
    place = F.row_number().over(W.partitionBy("l_partkey").orderBy(*derived.LINE_ORDER))
    rows = derived.table(spark, sf_dir, "lineitem").filter(F.col("l_partkey") % 9 != 0)
    tries = rows.select(F.col("l_partkey").alias("product_id"), place.alias("seq"), (F.col("l_quantity") > 30).alias("zero_visible"), (F.col("l_discount") > 0.05).alias("edge_visible"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("value"))
    return readings.measures(tries, derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id")))


_CODES = "SELECT p_partkey AS product_id, CASE p_partkey % 3 WHEN 0 THEN 'categoria' WHEN 1 THEN 'genero' ELSE 'estado' END AS field, CASE p_size % 7 WHEN 0 THEN 'moda' WHEN 1 THEN 'mujer' WHEN 2 THEN 'Bueno' WHEN 3 THEN ' ' WHEN 4 THEN 'hogar' ELSE p_brand END AS value FROM part"


@query(f"""
WITH s AS ({_CODES}), t AS (SELECT product_id, field, nullif(trim(value), '') AS value FROM s)
SELECT product_id, field, 'vlm_sintesis: ' || field || ' not valid: ' || coalesce(value, 'null') AS failure FROM t
WHERE NOT CASE field WHEN 'categoria' THEN coalesce(value IN ({', '.join(repr(c) for c in dims.CATEGORIES)}), false) WHEN 'genero' THEN value IS NULL OR value IN ({', '.join(repr(c) for c in dims.GENDERS)}) ELSE value IS NULL OR value IN ({', '.join(repr(c) for c in dims.CHOICES)}) END
""")
def judged_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged codes of every part that are none of the known ones."""
    key, size = F.col("p_partkey") % 3, F.col("p_size") % 7
    field = F.when(key == 0, "categoria").when(key == 1, "genero").otherwise("estado")
    value = F.when(size == 0, "moda").when(size == 1, "mujer").when(size == 2, "Bueno").when(size == 3, " ").when(size == 4, "hogar").otherwise(F.col("p_brand"))
    rows = derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), field.alias("field"), value.alias("value"), F.lit("alta").alias("confidence"))
    return readings.judged_codes(rows)[1]


@query("""
WITH p AS (SELECT user_id AS product_id, (event_id % 40) || '.jpg' AS base_name, 'd' || (event_id % 6) || '/' || (event_id % 40) || '.jpg' AS path FROM events)
SELECT product_id, base_name, count(DISTINCT path) AS n FROM p GROUP BY ALL HAVING count(DISTINCT path) > 1
""")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names that files of one user in several folders share."""
    e = derived.table(spark, sf_dir, "events")
    path = F.concat(F.lit("d"), (F.col("event_id") % 6).cast("string"), F.lit("/"), (F.col("event_id") % 40).cast("string"), F.lit(".jpg"))
    return readings.name_collisions(e.select(F.col("user_id").alias("product_id"), path.alias("path")))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS photo_id FROM lineitem WHERE l_orderkey % 13 <> 0 AND l_linestatus = 'O')
SELECT DISTINCT l_orderkey AS product_id, l_orderkey * 10 + l_linenumber AS photo_id FROM lineitem WHERE l_orderkey * 10 + l_linenumber NOT IN (SELECT photo_id FROM p)
""")
def missing_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that a listing names but no table holds, or that have no file."""
    rows = derived.table(spark, sf_dir, "lineitem").withColumn("photo_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    asked = rows.groupBy(F.col("l_orderkey").alias("product_id")).agg(F.collect_set("photo_id").alias("photos"))
    held = rows.filter(F.col("l_orderkey") % 13 != 0).select("photo_id", F.when(F.col("l_linestatus") == "O", F.concat(F.lit("/p/"), F.col("photo_id").cast("string"))).alias("path"))
    return ordering.missing_photos(asked, held)


@query("""
SELECT o_orderkey AS command_id, CASE WHEN o_orderkey % 11 = 0 THEN -1 - o_custkey ELSE o_custkey END AS lot_id, 'unknown_lot' AS reason FROM orders WHERE o_orderkey % 11 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def unknown_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that name a lot which does not exist."""
    lot = F.when(F.col("o_orderkey") % 11 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))
    commands = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("command_id"), lot.alias("lot_id"))
    lots = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lot_id"))
    return ledger.unknown_targets(commands, lots, "lot_id").select("command_id", "lot_id", "reason")


@query(EVENTS + "SELECT product_id, listed_at, price_cents, times FROM pub WHERE platform = 'vinted'")
def listed_on_vinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed on one platform."""
    rows = ledger.publication_state(ledger.publications_of(_state(spark, sf_dir)), "vinted")
    return rows.select("product_id", F.col("listed_at").cast("timestamp_ntz").alias("listed_at"), "price_cents", "times")


@query(LOTS + """
, p AS (SELECT lot_id, count(*) AS p, count(*) FILTER (confirmed) AS c FROM pr GROUP BY lot_id), f AS (SELECT lot_id, count(*) AS f FROM ph GROUP BY lot_id)
SELECT lot_id, 'lot ' || lot_id || ' (' || coalesce(f, 0) || ' photos, ' || coalesce(c, 0) || '/' || coalesce(p, 0) || ')' AS label FROM lots LEFT JOIN p USING (lot_id) LEFT JOIN f USING (lot_id)
""")
def lot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every lot: its name, photos and progress."""
    rows = ledger.lot_overview(*_lots(spark, sf_dir))
    name = F.concat(F.lit("lot "), F.col("lot_id").cast("string"))
    return rows.select("lot_id", listings.lot_label(name, F.col("photos"), F.col("confirmed"), F.col("products")).alias("label"))


@query("""
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN ' ' END AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand FROM part)
SELECT k AS product_id, left(CAST(k AS VARCHAR), 8) || ' ' || coalesce(nullif(trim(title), ''), nullif(trim(brand), ''), '?') || ' (' || (k % 6) || ')' || CASE WHEN k % 2 = 0 THEN ' ok' ELSE '' END AS label FROM p
""")
def product_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every product: its key, title or brand, photos and state."""
    k = F.col("p_partkey")
    title, brand = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.lit(" ")), F.when(k % 5 != 0, F.col("p_brand"))
    return derived.table(spark, sf_dir, "part").select(k.alias("product_id"), listings.product_label(k, title, brand, k % 6, k % 2 == 0).alias("label"))


@query("""
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 4 <> 0 AND trim(p_brand) <> '' THEN p_brand WHEN p_partkey % 3 = 0 THEN p_name WHEN p_size % 2 = 0 THEN p_type END AS value FROM part
""")
def default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that a form starts with: the field's, else the first reading that is not blank."""
    k = F.col("p_partkey")
    said = F.array(F.when(k % 3 == 0, F.col("p_name")).otherwise(" "), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""))
    return derived.table(spark, sf_dir, "part").select(k.alias("product_id"), listings.default_value(F.when(k % 4 != 0, F.col("p_brand")), said).alias("value"))


@query("""
SELECT p_partkey AS product_id, concat_ws(' ', CASE WHEN p_partkey % 4 <> 0 THEN p_brand END, p_name, NULL, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) END) AS terms FROM part
""")
def relaxed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms from whatever is known of a product, of any source."""
    k = F.col("p_partkey")
    wide = derived.table(spark, sf_dir, "part").select(k.alias("product_id"), F.when(k % 4 != 0, F.col("p_brand")).alias("marca"), F.col("p_name").alias("modelo"), F.lit(None).cast("string").alias("ean"), F.when(k % 2 == 0, F.col("p_size").cast("string")).alias("talla"))
    return listings.relaxed_query(wide)


@query(LOTS + """
, a AS (SELECT lot_id, count(*) AS pending FROM pr WHERE NOT confirmed GROUP BY lot_id), b AS (SELECT lot_id, count(*) AS confirmed FROM pr WHERE confirmed GROUP BY lot_id)
SELECT lot_id, coalesce(pending, 0) AS pending, coalesce(b.confirmed, 0) AS confirmed FROM a FULL JOIN b USING (lot_id)
""")
def curation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and confirmed products of every lot."""
    _, products, _ = _lots(spark, sf_dir)
    return listings.curation_progress(products.filter("NOT confirmed"), products)


@query("SELECT CASE WHEN l_discount > 0.05 THEN 'new_group' ELSE 'same_group' END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each label of a truth table occurs."""
    return evals.label_counts(derived.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_discount") > 0.05, "new_group").otherwise("same_group").alias("label")))
