"""Queries over sales: prices from comparables, the ledger, references, lots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.functions import numbers as N
from listingops.operators import ledger, pricing, usage
from listingops.operators.dealing import dealt
from listingops.plans.registry import query
from listingops.sources import derived

WIDE = """
WITH attr AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS marca, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS modelo,
    CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS tipo, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS VARCHAR) END AS talla FROM part)
"""
LISTINGS = """
, lst AS (SELECT p_brand || ' ' || p_type AS query, l_orderkey * 10 + l_linenumber AS rank, l_orderkey || '-' || l_linenumber AS url, floor(l_extendedprice * 100 / l_quantity + 0.5) / 100 AS price, p_name AS title FROM lineitem JOIN part ON l_partkey = p_partkey),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, url) AS k FROM lst WHERE price > 0) WHERE k <= 15),
val AS (SELECT query, count(*) AS n, floor(median(round_even(price * 100, 0)) + 0.5) / 100 AS median, min(price) AS least, max(price) AS most FROM top GROUP BY query)
"""
VARIANTS = """
, var AS (
  SELECT product_id, terms, min(pos) AS p0 FROM (
    SELECT product_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS pos, unnest([
      CASE WHEN marca IS NOT NULL AND modelo IS NOT NULL THEN concat_ws(' ', marca, modelo, tipo, talla) END, CASE WHEN marca IS NOT NULL AND modelo IS NOT NULL THEN concat_ws(' ', marca, modelo) END, modelo,
      CASE WHEN marca IS NOT NULL THEN concat_ws(' ', marca, tipo, talla) END, CASE WHEN marca IS NOT NULL THEN concat_ws(' ', marca, tipo) END, CASE WHEN marca IS NOT NULL THEN concat_ws(' ', marca, talla) END, marca]) AS terms FROM attr)
  WHERE terms IS NOT NULL GROUP BY product_id, terms),
vars AS (SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY p0) - 1 AS INTEGER) AS pos, terms FROM var)
"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.wide_attributes(derived.attributes(spark, sf_dir))


@query(WIDE + """
SELECT product_id, CASE WHEN coalesce(marca, modelo, tipo) IS NOT NULL THEN concat_ws(' ', marca, modelo, tipo, talla) ELSE '' END AS terms,
  CASE WHEN coalesce(marca, modelo, tipo) IS NOT NULL THEN 'aproximado' END AS match,
  CASE WHEN coalesce(marca, modelo, tipo) IS NOT NULL THEN 'by_text' WHEN talla IS NOT NULL THEN 'only_modifiers' ELSE 'no_data' END AS reason,
  CASE WHEN coalesce(marca, modelo, tipo) IS NOT NULL THEN 'https://es.wallapop.com/search?keywords=' || replace(replace(concat_ws(' ', marca, modelo, tipo, talla), '#', '%23'), ' ', '+') END AS url FROM attr
""")
def price_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of every product from its observed attributes."""
    return pricing.build_queries(_wide(spark, sf_dir)).select("product_id", "terms", "match", "reason", F.col("urls.wallapop").alias("url"))


@query(WIDE + VARIANTS + "SELECT product_id, pos, terms FROM vars")
def price_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search variants of every product, narrow to wide."""
    return pricing.search_variants(_wide(spark, sf_dir))


@query(WIDE.replace("THEN p_name END AS modelo", "THEN NULL END AS modelo").replace("THEN CAST(p_size AS VARCHAR) END AS talla", "THEN NULL END AS talla") + LISTINGS + """
, q AS (SELECT product_id, CASE WHEN coalesce(marca, tipo) IS NOT NULL THEN concat_ws(' ', marca, tipo) END AS shown, CASE WHEN marca IS NOT NULL THEN concat_ws(' ', marca, tipo) END AS terms FROM attr)
SELECT product_id, coalesce(shown, '') AS terms, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN median END AS median, CASE WHEN n >= 5 THEN least END AS least, CASE WHEN n >= 5 THEN most END AS most,
  CASE WHEN shown IS NULL THEN 'no_terms' WHEN terms IS NULL THEN 'cohort_too_wide' WHEN n >= 5 THEN 'median_asked' ELSE 'too_few' END AS reason FROM q LEFT JOIN val ON terms = query
""")
def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuation of every product by brand and type from comparable listings."""
    wide = _wide(spark, sf_dir).withColumn("modelo", F.lit(None).cast("string")).withColumn("talla", F.lit(None).cast("string"))
    return pricing.value_products(wide, derived.comparables(spark, sf_dir)).drop("comparables")


@query(WIDE + VARIANTS + LISTINGS + """
, vv AS (SELECT product_id, pos, terms, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN median END AS median FROM vars LEFT JOIN val ON terms = query)
SELECT product_id, count(*) AS variants, CAST(sum(n) AS BIGINT) AS comparables, arg_min(median, pos) FILTER (median IS NOT NULL) AS price FROM vv GROUP BY product_id
""")
def variant_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of every product valued; the first with a median suggests the price."""
    valued = pricing.value_variants(_wide(spark, sf_dir), derived.comparables(spark, sf_dir))
    counts = valued.groupBy("product_id").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("comparables"))
    return counts.join(pricing.suggested_price(valued), "product_id")


@query("""
WITH t AS (SELECT n_nationkey AS term_id, 'Brand#' || (n_nationkey % 5 + 1) || (n_regionkey % 5 + 1) AS b FROM nation), q AS (SELECT term_id, b || ' ' || ty AS terms FROM t, (SELECT DISTINCT p_type AS ty FROM part))
""" + LISTINGS + "SELECT term_id, terms, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN median END AS median FROM q LEFT JOIN val ON terms = query")
def term_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free terms valued: made-up brands beside every type."""
    n = derived.table(spark, sf_dir, "nation")
    types = derived.table(spark, sf_dir, "part").select("p_type").distinct()
    brand = F.concat(F.lit("Brand#"), (F.col("n_nationkey") % 5 + 1).cast("string"), (F.col("n_regionkey") % 5 + 1).cast("string"))
    terms = types.crossJoin(F.broadcast(n)).select(F.col("n_nationkey").alias("term_id"), F.concat_ws(" ", brand, "p_type").alias("terms"))
    return pricing.value_terms(terms, derived.comparables(spark, sf_dir)).select("term_id", "terms", "n", "median")


EVENTS = f"""
WITH line AS (
  SELECT l_partkey AS product_id, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(derived.LINE_ORDER)}) * 4 AS base, l_shipdate AS t0, CASE WHEN l_suppkey % 2 = 0 THEN 'vinted' ELSE 'wallapop' END AS platform, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS price_cents,
    CASE WHEN l_linenumber = 2 THEN l_orderkey END AS bundle_id, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_returnflag = 'A' AND l_orderkey % 3 = 0 THEN 'undo_sale' END AS after FROM lineitem),
ev AS (
  SELECT product_id, base AS seq, t0, 'published' AS type, platform, price_cents, NULL::BIGINT AS bundle_id FROM line
  UNION ALL SELECT product_id, base + 1, t0, 'sold', platform, price_cents, bundle_id FROM line
  UNION ALL SELECT product_id, base + 2, t0, after, NULL, NULL, NULL FROM line WHERE after IS NOT NULL),
cost AS (SELECT p_partkey AS product_id, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS cost_cents FROM part),
ep AS (SELECT *, coalesce(sum(CASE WHEN type = 'undo_sale' THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM ev),
ag AS (SELECT product_id, epoch, max(epoch) OVER (PARTITION BY product_id) AS latest, min(t0) FILTER (type = 'sold' AND seq = fs) AS sold_at, max(price_cents) FILTER (type = 'sold' AND seq = ls) AS price_cents, max(platform) FILTER (type = 'sold' AND seq = ls) AS platform,
    max(bundle_id) FILTER (type = 'sold' AND seq = bs) AS bundle_id, max(type) FILTER (seq = es) AS last_type, max(fs) AS fs FROM (
    SELECT *, min(CASE WHEN type = 'sold' THEN seq END) OVER w AS fs, max(CASE WHEN type = 'sold' THEN seq END) OVER w AS ls, max(CASE WHEN type = 'sold' AND bundle_id IS NOT NULL THEN seq END) OVER w AS bs, max(CASE WHEN type <> 'published' THEN seq END) OVER w AS es FROM ep WINDOW w AS (PARTITION BY product_id, epoch)) WHERE type <> 'published' GROUP BY product_id, epoch),
sale AS (SELECT ag.product_id, price_cents, platform, bundle_id, sold_at, cost_cents, CASE WHEN last_type = 'returned' THEN 'devuelta' ELSE 'vendida' END AS state FROM ag JOIN cost USING (product_id) WHERE epoch = latest AND last_type <> 'undo_sale' AND fs IS NOT NULL),
pub AS (SELECT product_id, platform, min(t0) AS listed_at, arg_max(price_cents, seq) AS price_cents, count(*) AS times FROM ev WHERE type = 'published' GROUP BY product_id, platform)
"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.folded(derived.events(spark, sf_dir))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products; every 97th has been deleted."""
    p = derived.table(spark, sf_dir, "part").filter(F.col("p_partkey") % 97 != 0)
    return p.select(F.col("p_partkey").alias("product_id"), (F.col("p_partkey") % 50).alias("lot_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("reference"), F.rint(F.col("p_retailprice") * 100).cast("long").alias("cost_cents"))


@query(EVENTS + "SELECT product_id, platform, listed_at, price_cents, times FROM pub")
def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First listing time and latest price of every product and platform."""
    return ledger.publications_of(_state(spark, sf_dir)).withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))


@query(EVENTS + "SELECT product_id, price_cents, platform, bundle_id, sold_at, cost_cents AS cost_snap_cents, state FROM sale")
def standing_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sale that stands for each product, with its frozen cost."""
    out = ledger.sales_of(_state(spark, sf_dir))
    return out.select("product_id", "price_cents", "platform", "bundle_id", F.col("sold_at").cast("timestamp_ntz").alias("sold_at"), "cost_snap_cents", "state")


LEDGER = EVENTS + """
, ids AS (SELECT product_id FROM pub UNION SELECT product_id FROM sale),
prod AS (SELECT p_partkey AS product_id, p_partkey % 50 AS lot_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS reference, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS cost FROM part WHERE p_partkey % 97 <> 0),
pl AS (SELECT product_id, max(listed_at) AS listed_at, string_agg(platform || ' (' || strftime(listed_at, '%Y-%m-%d') || ')', '; ' ORDER BY platform) AS listed FROM pub GROUP BY product_id),
led AS (SELECT i.product_id, lot_id, reference, title, CASE WHEN state IS NOT NULL THEN cost_cents ELSE cost END AS cost_cents, price_cents, platform, state, CASE WHEN state = 'vendida' THEN price_cents - cost_cents END AS profit_cents, greatest(listed_at, sold_at) AS latest_at, sold_at, listed
  FROM ids i LEFT JOIN prod USING (product_id) LEFT JOIN sale USING (product_id) LEFT JOIN pl USING (product_id))
"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger(_products(spark, sf_dir), _state(spark, sf_dir))


@query(LEDGER + "SELECT product_id, lot_id, reference, title, cost_cents, price_cents, platform, state, profit_cents, latest_at FROM led")
def sales_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with a publication or a sale."""
    return _ledger(spark, sf_dir).select("product_id", "lot_id", "reference", "title", "cost_cents", "price_cents", "platform", "state", "profit_cents", F.col("latest_at").cast("timestamp_ntz").alias("latest_at"))


@query(LEDGER + "SELECT CAST(coalesce(sum(price_cents) FILTER (state = 'vendida'), 0) AS BIGINT) AS sold_cents, CAST(coalesce(sum(profit_cents), 0) AS BIGINT) AS profit_cents FROM led")
def sales_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total sold and gross profit."""
    return ledger.totals(_ledger(spark, sf_dir))


@query(LEDGER + "SELECT product_id FROM led WHERE state = 'devuelta' AND (contains(lower(coalesce(title, '')), 're') OR contains(coalesce(CAST(reference AS VARCHAR), ''), 're'))")
def returned_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned products whose title or reference holds a text."""
    return ledger.filtered(_ledger(spark, sf_dir), "devuelta", "RE").select("product_id")


@query(LEDGER + """
SELECT product_id, coalesce(CAST(reference AS VARCHAR), '') AS reference, coalesce(title, '') AS title, coalesce(CAST(CAST(cost_cents AS DECIMAL(20, 2)) / 100 AS DECIMAL(20, 2))::VARCHAR, '') AS cost, coalesce(listed, '') AS listed,
  CASE state WHEN 'vendida' THEN 'sí' WHEN 'devuelta' THEN 'devuelta' ELSE 'no' END AS sold, coalesce(CAST(CAST(price_cents AS DECIMAL(20, 2)) / 100 AS DECIMAL(20, 2))::VARCHAR, '') AS price, coalesce(platform, '') AS platform,
  coalesce(strftime(sold_at, '%Y-%m-%d'), '') AS sold_at, coalesce(CAST(CAST(profit_cents AS DECIMAL(20, 2)) / 100 AS DECIMAL(20, 2))::VARCHAR, '') AS profit FROM led
""")
def ledger_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten report columns of every ledger row."""
    return ledger.report(_ledger(spark, sf_dir))


@query(EVENTS + "SELECT bundle_id, count(*) AS n, CAST(sum(price_cents) AS BIGINT) AS price_cents, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM sale WHERE bundle_id IS NOT NULL GROUP BY bundle_id")
def bundle_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of sales that share a bundle."""
    return ledger.bundles(ledger.sales_of(_state(spark, sf_dir)))


@query(EVENTS + "SELECT p.product_id, p.platform FROM pub p JOIN sale s USING (product_id) WHERE s.state = 'vendida' AND p.platform <> s.platform")
def still_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold products that are still listed on another platform."""
    fold = _state(spark, sf_dir)
    return ledger.still_listed(ledger.sales_of(fold), ledger.publications_of(fold))


@query(EVENTS + """
SELECT product_id, first(platform ORDER BY listed_at DESC, platform) AS platform, first(price_cents ORDER BY listed_at DESC, platform) FILTER (price_cents IS NOT NULL) AS price_cents FROM pub GROUP BY product_id
""")
def latest_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each product was listed last, and at what price."""
    return ledger.latest_publication(ledger.publications_of(_state(spark, sf_dir)))


@query(EVENTS + """
, st AS (SELECT *, last_value(CASE type WHEN 'sold' THEN true WHEN 'undo_sale' THEN false END IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT * FROM ev WHERE seq % 40 <> 5))
SELECT product_id, seq, 'no_sale' AS reason FROM st WHERE type IN ('undo_sale', 'returned') AND NOT coalesce(before, false)
""")
def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo and return events without a standing sale, after some sales have been lost."""
    some = derived.events(spark, sf_dir).filter(F.pmod("seq", F.lit(40)) != 5)
    return ledger.checked_events(some)[1].select("product_id", "seq", "reason")


@query("""
WITH h AS (SELECT o_custkey AS product_id, max(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), w AS (SELECT o_custkey AS product_id, min(o_orderdate) AS t FROM orders GROUP BY o_custkey)
SELECT product_id, (SELECT coalesce(max(n), 0) FROM h) + row_number() OVER (ORDER BY t, product_id) AS reference FROM w WHERE product_id NOT IN (SELECT product_id FROM h)
""")
def reference_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as products: those without a filled order get numbers above the highest filled order."""
    o = derived.table(spark, sf_dir, "orders")
    history = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("product_id")).agg(F.max("o_orderkey").alias("n"))
    waiting = o.groupBy(F.col("o_custkey").alias("product_id")).agg(F.min("o_orderdate").alias("created_at"))
    return ledger.assign_references(waiting, history)


LOTS = """
WITH lots AS (SELECT c_custkey AS lot_id FROM customer), pr AS (SELECT o_orderkey AS product_id, o_custkey AS lot_id, o_orderstatus = 'F' AS confirmed FROM orders),
ph AS (SELECT l_orderkey * 10 + l_linenumber AS photo_id, l_orderkey AS product_id, o_custkey AS lot_id, l_linestatus = 'O' AS readable, l_shipdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 13 <> 0)
"""


def _lots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, l_ = derived.table(spark, sf_dir, "orders"), derived.table(spark, sf_dir, "lineitem")
    lots = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lot_id"))
    products = o.select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("lot_id"), (F.col("o_orderstatus") == "F").alias("confirmed"))
    rows = dealt(l_.filter(F.col("l_orderkey") % 13 != 0), "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    photos = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("photo_id"), F.col("l_orderkey").alias("product_id"), F.col("o_custkey").alias("lot_id"), (F.col("l_linestatus") == "O").alias("readable"), F.col("l_shipdate").alias("captured_at"), F.col("l_shipdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("confirmed"))
    return lots, products, photos


@query(LOTS + "SELECT lot_id, coalesce(f, 0) AS photos, coalesce(p, 0) AS products, coalesce(c, 0) AS confirmed FROM lots LEFT JOIN (SELECT lot_id, count(*) AS p, count(*) FILTER (confirmed) AS c FROM pr GROUP BY lot_id) USING (lot_id) LEFT JOIN (SELECT lot_id, count(*) AS f FROM ph GROUP BY lot_id) USING (lot_id)")
def lot_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos, products and confirmed products of every lot."""
    lots, products, photos = _lots(spark, sf_dir)
    return ledger.lot_overview(lots, products, photos).select("lot_id", "photos", "products", "confirmed")


@query(LOTS + "SELECT product_id, coalesce(ids, '') AS photo_ids FROM pr LEFT JOIN (SELECT product_id, string_agg(CAST(photo_id AS VARCHAR), ',' ORDER BY t, photo_id) AS ids FROM ph GROUP BY product_id) USING (product_id)")
def product_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with its photos in order."""
    _, products, photos = _lots(spark, sf_dir)
    out = ledger.products_with_photos(products, photos.withColumn("photo_id", F.col("photo_id").cast("string")))
    return out.select("product_id", F.array_join("photo_ids", ",").alias("photo_ids"))


@query(LOTS + "SELECT product_id, 'orphan' AS kind FROM pr WHERE NOT confirmed AND product_id NOT IN (SELECT product_id FROM ph) UNION ALL SELECT product_id, 'confirmable' FROM pr WHERE NOT confirmed AND product_id IN (SELECT product_id FROM ph WHERE readable)")
def product_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products to clean up and products to confirm."""
    _, products, photos = _lots(spark, sf_dir)
    return ledger.orphans(products, photos).select("product_id", F.lit("orphan").alias("kind")).union(ledger.confirmable(products, photos).select("product_id", F.lit("confirmable")))


@query(LOTS + """
, cmd AS (SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 'discard' ELSE 'archive' END AS action FROM ph WHERE photo_id % 9 = 0 UNION ALL SELECT -photo_id, 'discard' FROM ph WHERE photo_id % 500 = 0),
j AS (SELECT cmd.*, lot_id, readable, confirmed FROM cmd LEFT JOIN (SELECT ph.*, pr.confirmed FROM ph JOIN pr USING (product_id)) USING (photo_id))
SELECT photo_id, action, CASE WHEN lot_id IS NULL THEN 'unknown_photo' WHEN action = 'discard' AND readable THEN 'readable' ELSE 'confirmed' END AS reason FROM j WHERE lot_id IS NULL OR (action = 'discard' AND readable) OR (action = 'archive' AND confirmed)
""")
def refused_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discard and archive commands that are refused."""
    _, _, photos = _lots(spark, sf_dir)
    own = photos.filter(F.col("photo_id") % 9 == 0).select("photo_id", F.when(F.col("photo_id") % 2 == 0, "discard").otherwise("archive").alias("action"))
    gone = photos.filter(F.col("photo_id") % 500 == 0).select((-F.col("photo_id")).alias("photo_id"), F.lit("discard").alias("action"))
    return ledger.removed_photos(photos, own.union(gone))[2]


@query("""
WITH gone AS (SELECT c_custkey AS lot_id FROM customer WHERE c_custkey % 4 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')), pr AS (SELECT o_orderkey AS product_id, o_custkey AS lot_id FROM orders)
SELECT 'lots' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT lot_id FROM gone) UNION ALL SELECT 'products', count(*) FROM pr WHERE lot_id NOT IN (SELECT lot_id FROM gone)
UNION ALL SELECT 'photos', count(*) FROM lineitem JOIN pr ON l_orderkey = product_id WHERE l_orderkey % 13 <> 0 AND lot_id NOT IN (SELECT lot_id FROM gone) UNION ALL SELECT 'fields', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT product_id FROM pr WHERE lot_id IN (SELECT lot_id FROM gone))
""")
def tables_after_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each table keeps after every fourth lot is deleted; lots with an open order stay."""
    lots, products, photos = _lots(spark, sf_dir)
    fields = derived.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("product_id"), F.col("l_partkey").cast("string").alias("value"))
    sold = derived.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("lot_id"))
    left = ledger.without_lots({"lots": lots, "products": products, "photos": photos, "fields": fields}, lots.filter(F.col("lot_id") % 4 == 0), sold)
    counts = [rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, rows in left.items()]
    return reduce(DataFrame.unionByName, counts)


@query("""
SELECT o_custkey AS lot_id, max(o_orderdate) AS created_at FROM orders GROUP BY o_custkey
""")
def newest_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots by the time of their last order, newest first."""
    o = derived.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("lot_id")).agg(F.max("o_orderdate").alias("created_at"))
    return ledger.newest_lots(o)


@query("""
SELECT c_custkey AS lot_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS refused FROM customer WHERE c_custkey % 4 = 0
""")
def lot_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to delete every fourth lot; lots with an open order as a sale are refused."""
    lots, _, _ = _lots(spark, sf_dir)
    asked = lots.filter(F.col("lot_id") % 4 == 0)
    sold = derived.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("lot_id"))
    kept, refused = ledger.deleted_lots(lots, asked, sold)
    gone = asked.join(kept, "lot_id", "left_anti")
    return refused.withColumn("refused", F.lit(True)).union(gone.withColumn("refused", F.lit(False)))


@query("""
SELECT o_custkey % 20 AS lot_id, o_orderkey % 300 AS product_id, count(*) FILTER (o_orderstatus <> 'F') AS calls, count(*) FILTER (o_orderstatus = 'F') AS hits, CAST(coalesce(sum(o_orderkey % 2000) FILTER (o_orderstatus <> 'F'), 0) AS BIGINT) AS tokens_in,
  CAST(coalesce(sum(o_custkey % 400) FILTER (o_orderstatus <> 'F'), 0) AS BIGINT) AS tokens_out, round(coalesce(sum((o_orderkey % 2000) / 1e6 * 1.0 + (o_custkey % 400) / 1e6 * 5.0) FILTER (o_orderstatus <> 'F'), 0), 6) AS cost FROM orders GROUP BY ALL
""")
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as model answers: calls, reused answers, tokens and cost of every lot and product."""
    o = derived.table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 20).alias("lot_id"), (F.col("o_orderkey") % 300).alias("product_id"), F.lit("small").alias("model"), (F.col("o_orderkey") % 2000).alias("tokens_in"), (F.col("o_custkey") % 400).alias("tokens_out"), F.lit(0).alias("cache_read"), (F.col("o_orderstatus") == "F").alias("cached"))
    prices = spark.createDataFrame([("small", 1.0, 5.0), ("large", 3.0, 15.0)], "model string, price_in double, price_out double")
    return usage.usage_by(rows, prices, ["lot_id", "product_id"]).drop("cache_read").withColumn("cost", F.round("cost", 6))


@query("""
WITH r AS (SELECT o_orderkey % 1000 AS key, CASE WHEN o_custkey % 2 = 0 THEN 'text' ELSE 'image' END AS kind, o_custkey % 4 AS n FROM orders), c AS (SELECT DISTINCT o_orderkey % 1000 AS key FROM orders WHERE o_orderstatus = 'P')
SELECT count(*) AS total, count(c.key) AS cached, count(*) FILTER (c.key IS NULL) AS payable, round(sum(CASE WHEN c.key IS NULL THEN (CASE WHEN kind = 'image' THEN n * 1600 ELSE 800 END) / 1e6 * 1.0 + 300 / 1e6 * 5.0 ELSE 0 END), 4) AS cost
FROM r LEFT JOIN c USING (key) WHERE kind = 'text' OR n > 0
""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as planned requests: how many are paid for already, and what the others cost."""
    o = derived.table(spark, sf_dir, "orders")
    key = (F.col("o_orderkey") % 1000).alias("key")
    requests = o.select(key, F.when(F.col("o_custkey") % 2 == 0, "text").otherwise("image").alias("kind"), (F.col("o_custkey") % 4).alias("n_images"))
    cache = o.select(key, (F.col("o_orderstatus") == "P").alias("valid"))
    return usage.estimate(requests, cache, 1.0, 5.0).withColumn("cost", F.round("cost", 4))


@query("""
SELECT p_partkey AS product_id, (CAST(p_retailprice * 100 AS BIGINT) / 100.0)::DECIMAL(20, 2)::VARCHAR AS shown, CAST(p_retailprice * 100 AS BIGINT) AS read_back, CASE WHEN p_size > 25 THEN CAST(round_even(p_size * 1.5 * 100, 0) AS BIGINT) END AS price_cents, CAST(round_even(greatest(0, (p_size - 25) * 1.25) * 100, 0) AS BIGINT) AS cost_cents FROM part
""")
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written, read back, chosen and frozen."""
    p = derived.table(spark, sf_dir, "part")
    shown = N.cents_text(F.rint(F.col("p_retailprice") * 100).cast("long"))
    return p.select(F.col("p_partkey").alias("product_id"), shown.alias("shown"), N.cents_of_text(F.replace(shown, F.lit("."), F.lit(","))).alias("read_back"), N.chosen_price_cents(F.when(F.col("p_size") > 25, F.col("p_size") * 1.5)).alias("price_cents"), N.cost_cents((F.col("p_size") - 25) * 1.25).alias("cost_cents"))


@query("""
WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 1000000 AS VARCHAR), CASE o_orderkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 13 ELSE 14 END, '5') AS digits FROM orders),
s AS (SELECT *, list_sum(list_transform(range(1, length(digits)), lambda i: CAST(digits[length(digits) - i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS total FROM d)
SELECT o_orderkey AS product_id, digits, (10 - total % 10) % 10 = CAST(digits[length(digits)] AS INTEGER) AS valid FROM s
""")
def ean_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits of codes made of order keys, in four lengths."""
    o = derived.table(spark, sf_dir, "orders")
    size = F.when(F.col("o_orderkey") % 4 == 0, 8).when(F.col("o_orderkey") % 4 == 1, 12).when(F.col("o_orderkey") % 4 == 2, 13).otherwise(14)
    digits = F.lpad((F.col("o_orderkey") * 7919 + 1000000).cast("string"), size, F.lit("5"))
    return o.select(F.col("o_orderkey").alias("product_id"), digits.alias("digits"), N.ean_valid(digits).alias("valid"))
