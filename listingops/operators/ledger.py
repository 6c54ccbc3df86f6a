"""The sales ledger from product events: publications, sales with frozen costs, returns, undo.

events: product_id, seq, at, type, platform, price_cents, cost_cents, title, reference, bundle_id, sold_at. Types:
published, sold, undo_sale, returned, cost, title, reference. seq orders a product's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions import numbers as N
from listingops.functions.text import guarded
from listingops.operators.dealing import dealt
from listingops.sources import dims


def bad_values() -> Column:
    """Why an event's own values reject it, or null."""
    bad_cents = (F.coalesce("price_cents", F.lit(0)) < 0) | (F.coalesce("cost_cents", F.lit(0)) < 0)
    bad_platform = F.col("type").isin("published", "sold") & ~F.coalesce(F.col("platform").isin(*dims.PLATFORMS), F.lit(False))
    return F.when(bad_cents, "negative_cents").when(bad_platform, "unknown_platform")


def _judged(events: DataFrame, products: DataFrame | None) -> DataFrame:
    """events with reason: why one is rejected, or null. One exchange, by product."""
    w = W.partitionBy("product_id").orderBy("seq")
    rows = dealt(events, "product_id").withColumn("reason", bad_values())
    if products is not None:
        known = products.select("product_id", F.lit(True).alias("_known"))
        rows = rows.join(known, "product_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_known").isNull(), "unknown_product"))).drop("_known")
    state = F.when(F.col("reason").isNull(), F.when(F.col("type") == "sold", True).when(F.col("type") == "undo_sale", False))
    before = F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_orphan", F.col("type").isin("undo_sale", "returned") & ~before)
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.col("_orphan"), "no_sale"))).drop("_orphan")


def checked_events(events: DataFrame, products: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects with reason): negative cents, unknown platforms, unknown products, and undo or return
    without a standing sale are rejected."""
    rows = _judged(events, products)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def folded(events: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """product_id, publications, sale, live: all that the accepted events of each product come to, in one exchange.

    publications: array of platform, listed_at (first), price_cents (latest, also to null), times, by platform. sale:
    the standing one as sales() gives it, or null. live: cost_cents (0 where never set), title and reference now. Checks,
    running values and sums share the partitioning by product; no product is collected: windows run over its events in
    order, and the sums keep one row.
    """
    w = W.partitionBy("product_id").orderBy("seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    last = lambda kind, c: F.last(F.when(F.col("type") == kind, F.col(c)), ignorenulls=True).over(upto)
    undone = F.coalesce(F.sum((F.col("type") == "undo_sale").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = _judged(events, products).filter("reason IS NULL").select("*", undone.alias("_epoch"), F.coalesce(last("cost", "cost_cents"), F.lit(0).cast("long")).alias("_cost"), last("title", "title").alias("_title"), last("reference", "reference").alias("_ref"))
    sold, ends = F.col("type") == "sold", F.col("type").isin("sold", "returned", "undo_sale")
    newest = lambda kind, c: F.max(F.when(F.col("type") == kind, F.struct("seq", c)))[c]

    def listed(p: str) -> list[Column]:
        own = (F.col("type") == "published") & (F.col("platform") == p)
        return [F.min(F.when(own, F.col("at"))).alias(f"_at_{p}"), F.max(F.when(own, F.struct("seq", "price_cents")))["price_cents"].alias(f"_price_{p}"), F.count_if(own).alias(f"_times_{p}")]

    out = rows.groupBy("product_id").agg(
        # the last epoch with a sale is the standing one, unless an undo ends it
        F.max(F.when(sold, F.struct("_epoch", (-F.col("seq")).alias("_back"), "_cost", "_title", "_ref", F.coalesce("sold_at", "at").alias("sold_at"), "at"))).alias("_first"),
        F.max(F.when(sold, F.struct("seq", "price_cents", "platform"))).alias("_last"),
        F.max(F.when(sold, F.struct("_epoch", F.when(F.col("bundle_id").isNotNull(), F.col("seq")).alias("seq"), "bundle_id"))).alias("_bundle"),
        F.max(F.when(ends, F.struct("seq", "type", "at"))).alias("_end"),
        newest("cost", "cost_cents").alias("_cost"), newest("title", "title").alias("_title"), newest("reference", "reference").alias("_ref"),
        *(c for p in dims.PLATFORMS for c in listed(p)),
    )
    state = F.when(F.col("_end.type") == "returned", "devuelta").otherwise("vendida")
    sale = F.struct(F.col("_first._ref").alias("reference_snap"), F.col("_first._title").alias("title_snap"), F.col("_first._cost").alias("cost_snap_cents"), F.col("_last.price_cents").alias("price_cents"), F.col("_last.platform").alias("platform"), state.alias("state"), F.col("_bundle.bundle_id").alias("bundle_id"), F.col("_first.sold_at").alias("sold_at"), F.col("_first.at").alias("created_at"), F.col("_end.at").alias("updated_at"))
    places = F.array(*(F.when(F.col(f"_times_{p}") > 0, F.struct(F.lit(p).alias("platform"), F.col(f"_at_{p}").alias("listed_at"), F.col(f"_price_{p}").alias("price_cents"), F.col(f"_times_{p}").alias("times"))) for p in sorted(dims.PLATFORMS)))
    live = F.struct(F.coalesce("_cost", F.lit(0).cast("long")).alias("cost_cents"), F.col("_title").alias("title"), F.col("_ref").alias("reference"))
    return out.select("product_id", F.array_compact(places).alias("publications"), F.when(F.col("_end.type") != "undo_sale", sale).alias("sale"), live.alias("live"))


def publications(events: DataFrame) -> DataFrame:
    """product_id, platform, listed_at (first), price_cents (latest, also to null), times of accepted published events."""
    return publications_of(folded(events))


def publications_of(fold: DataFrame) -> DataFrame:
    return fold.select("product_id", F.inline("publications"))


def live_products(events: DataFrame) -> DataFrame:
    """product_id, cost_cents, title, reference now: the last of each kind; cost 0 where never set."""
    return folded(events).select("product_id", "live.*")


def sales(events: DataFrame) -> DataFrame:
    """The standing sale of each product: snapshots frozen at the first sale since the last undo, price, platform and
    state of the last event, bundle as the last one given.

    An epoch is what lies between undo events; only the last epoch's sale stands. A sale after a return re-opens it
    with the old snapshots.
    """
    return sales_of(folded(events))


def sales_of(fold: DataFrame) -> DataFrame:
    return fold.filter("sale IS NOT NULL").select("product_id", "sale.*")


def ledger(products: DataFrame, fold: DataFrame) -> DataFrame:
    """One row for each product with a publication or a sale; ordered() puts them latest first.

    Live title and reference where the product exists, else the sale's snapshots; the cost shown is the sale's
    snapshot where there is a sale. profit_cents is null for returns and unknown prices. zero_cost_warning marks unsold
    products whose cost is missing or 0: a sale would freeze the price as profit.
    """
    own = fold.filter("size(publications) > 0 OR sale IS NOT NULL").select("product_id", F.when(F.size("publications") > 0, F.col("publications")).alias("publications"), "sale")
    live = products.select("product_id", "lot_id", F.col("title").alias("_title"), F.col("reference").alias("_ref"), F.col("cost_cents").alias("_cost"), F.lit(True).alias("_live"))
    alive, has_sale = F.coalesce("_live", F.lit(False)), F.col("sale").isNotNull()
    out = own.join(live, "product_id", "left").select(
        "product_id", "lot_id",
        F.when(alive, F.col("_ref")).otherwise(F.col("sale.reference_snap")).alias("reference"),
        F.when(alive, F.col("_title")).otherwise(F.col("sale.title_snap")).alias("title"),
        F.when(has_sale, F.col("sale.cost_snap_cents")).otherwise(F.col("_cost")).alias("cost_cents"),
        "sale.price_cents", "sale.platform", "sale.state", "sale.bundle_id", "sale.sold_at", "publications",
        N.gross_profit(F.col("sale.state"), F.col("sale.price_cents"), F.col("sale.cost_snap_cents")).alias("profit_cents"),
        F.greatest(F.array_max(F.transform("publications", lambda p: p["listed_at"])), F.col("sale.sold_at")).alias("latest_at"),
    )
    return out.withColumn("zero_cost_warning", F.col("state").isNull() & (F.coalesce("cost_cents", F.lit(0)) == 0))


def ordered(rows: DataFrame) -> DataFrame:
    """Ledger rows by latest time, then product: a range sort, no single task."""
    return rows.orderBy(F.col("latest_at").desc_nulls_last(), "product_id")


def totals(rows: DataFrame) -> DataFrame:
    """sold_cents (only standing sales with a price) and profit_cents; 0 where there are none."""
    return rows.agg(F.coalesce(F.sum(F.when(F.col("state") == "vendida", F.col("price_cents"))), F.lit(0)).alias("sold_cents"), F.coalesce(F.sum("profit_cents"), F.lit(0)).alias("profit_cents"))


def filtered(rows: DataFrame, state: str | None = None, query: str | None = None) -> DataFrame:
    """Rows in a state (unsold, vendida, devuelta; None: all) whose reference or title holds query, case ignored."""
    if state == "unsold":
        rows = rows.filter("state IS NULL")
    elif state:
        rows = rows.filter(F.col("state") == state)
    q = (query or "").strip().lower()
    return rows.filter(F.lower(F.coalesce("title", F.lit(""))).contains(q) | F.coalesce(F.col("reference").cast("string"), F.lit("")).contains(q)) if q else rows


def bundles(sold: DataFrame) -> DataFrame:
    """bundle_id, n, price_cents, cost_cents of sales sold together."""
    return sold.filter("bundle_id IS NOT NULL").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price_cents").alias("price_cents"), F.sum("cost_snap_cents").alias("cost_cents"))


def still_listed(sold: DataFrame, pubs: DataFrame) -> DataFrame:
    """product_id, platform where a sold product is still listed elsewhere."""
    s = sold.filter("state = 'vendida'").select("product_id", F.col("platform").alias("_sold_on"))
    return pubs.join(s, "product_id").filter(F.col("platform") != F.coalesce("_sold_on", F.lit(""))).select("product_id", "platform")


def latest_publication(pubs: DataFrame) -> DataFrame:
    """product_id, platform (of the latest), price_cents (of the latest with a price); ties to the first platform."""
    held = pubs.groupBy("product_id").agg(F.collect_list(F.struct("listed_at", "platform", "price_cents")).alias("own"))  # one for each platform

    def newest(own: Column) -> Column:  # the least platform of the latest time
        at = F.array_max(F.transform(own, lambda p: p["listed_at"]))
        return F.array_min(F.transform(F.filter(own, lambda p: p["listed_at"].eqNullSafe(at)), lambda p: F.struct(p["platform"].alias("platform"), p["price_cents"].alias("price_cents"))))

    priced = F.filter("own", lambda p: p["price_cents"].isNotNull())
    return held.select("product_id", newest(F.col("own"))["platform"].alias("platform"), newest(priced)["price_cents"].alias("price_cents"))


def publication_state(pubs: DataFrame, platform: str) -> DataFrame:
    return pubs.filter(F.col("platform") == platform)


def platform_options(rows: DataFrame) -> DataFrame:
    """rows(product_id, publications) with options: platforms used, sorted, then the others."""
    used = F.array_sort(F.array_distinct(F.transform("publications", lambda p: p["platform"])))
    used = F.coalesce(used, F.expr("CAST(array() AS array<string>)"))
    return rows.withColumn("options", F.concat(used, F.array_except(F.array(*(F.lit(p) for p in ("wallapop", "vinted"))), used)))


def report(rows: DataFrame) -> DataFrame:
    """Text columns of the ledger report, in the order of rows; null cells are blank, formulas are guarded."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    listed = F.array_join(F.transform("publications", lambda p: F.concat(p["platform"], F.lit(" ("), F.date_format(p["listed_at"], "yyyy-MM-dd"), F.lit(")"))), "; ")
    sold = F.when(F.col("state") == "vendida", "sí").when(F.col("state") == "devuelta", "devuelta").otherwise("no")
    text = lambda c: guarded(F.coalesce(c, F.lit("")))
    return rows.select("product_id", F.coalesce(F.col("reference").cast("string"), F.lit("")).alias("reference"), text(F.col("title")).alias("title"), N.cents_text(F.col("cost_cents")).alias("cost"), text(listed).alias("listed"), sold.alias("sold"), N.cents_text(F.col("price_cents")).alias("price"), text(F.col("platform")).alias("platform"), day("sold_at").alias("sold_at"), N.cents_text(F.col("profit_cents")).alias("profit"))


RANGE_SAMPLE = 20  # rows drawn for each range


def range_bounds(rows: DataFrame, key: str, ranges: int) -> list[tuple]:
    """At most ranges - 1 values of key, a struct of plain columns, that cut rows(product_id, key) into ranges of about one size.

    Taken once, from RANGE_SAMPLE rows a range drawn by a hash of product_id, so that every later reading of the rows,
    however often Spark evaluates them, is cut alike.
    """
    share = min(1.0, RANGE_SAMPLE * ranges / max(1, rows.count()))
    drawn = sorted(tuple(r[0]) for r in rows.filter(F.pmod(F.xxhash64("product_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(key).collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)} if drawn else ())


def assign_references(waiting: DataFrame, history: DataFrame, ranges: int = 32) -> DataFrame:
    """product_id, reference of waiting(product_id, created_at) products without one in history(product_id, n).

    Numbers go on above the highest ever issued, by created_at (nulls first), then product, and are never reused. Order
    is global without a single task: rows are dealt to ranges whose bounds are constants, counted by range and numbered
    within theirs.
    """
    at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62)))
    new = waiting.join(history.select("product_id"), "product_id", "left_anti").select("product_id", F.struct(at.alias("at"), "product_id").alias("_key"))
    above = F.lit(0)
    for t, product in range_bounds(new, "_key", ranges):
        above = above + (F.col("_key") > F.struct(F.lit(t), F.lit(product).cast(new.schema["product_id"].dataType))).cast("int")
    placed = new.withColumn("_range", above)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")  # one row for each range
    top = history.agg(F.coalesce(F.max("n"), F.lit(0)).alias("_top"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy("_key"))
    return placed.withColumn("_r", rank).join(F.broadcast(before), "_range").crossJoin(F.broadcast(top)).select("product_id", (F.col("_top") + F.col("_before") + F.col("_r")).cast("long").alias("reference"))


# -- state of listings and photos from their events ------------------------------------------------------------------


def field_maps(events: DataFrame) -> DataFrame:
    """product_id, fields_json, confirmed of events(product_id, seq, type, fields_json): the last of extracted (which
    clears the confirmation) and listing_confirmed."""
    own = events.filter(F.col("type").isin("extracted", "listing_confirmed"))
    return own.groupBy("product_id").agg(F.max(F.struct("seq", "type", "fields_json")).alias("x")).select("product_id", "x.fields_json", (F.col("x.type") == "listing_confirmed").alias("confirmed"))


def confirmations(events: DataFrame) -> DataFrame:
    """product_id, kind, first_at, times of grouping_confirmed and listing_confirmed; every one is a log row."""
    own = events.filter(F.col("type").isin("grouping_confirmed", "listing_confirmed"))
    return own.groupBy("product_id", F.when(F.col("type") == "grouping_confirmed", "agrupacion").otherwise("ficha").alias("kind")).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("times"))


def removed_photos(photos: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept photos, archived photos, rejected commands) after commands(photo_id, action discard or archive).

    Only unreadable photos may be discarded; photos of a confirmed product may not be archived; unknown photos reject.
    """
    rows = commands.join(photos, "photo_id", "left")
    reason = F.when(F.col("lot_id").isNull(), "unknown_photo").when((F.col("action") == "discard") & F.col("readable"), "readable").when((F.col("action") == "archive") & F.coalesce("confirmed", F.lit(False)), "confirmed")
    rows = rows.withColumn("reason", reason)
    done = rows.filter("reason IS NULL")
    kept = photos.join(done.select("photo_id"), "photo_id", "left_anti")
    return kept, done.filter("action = 'archive'").select(*photos.columns), rows.filter("reason IS NOT NULL").select("photo_id", "action", "reason")


def orphans(products: DataFrame, photos: DataFrame) -> DataFrame:
    """Unconfirmed products left without a photo."""
    return products.filter("NOT confirmed").join(photos.select("product_id").distinct(), "product_id", "left_anti")


def confirmable(products: DataFrame, photos: DataFrame) -> DataFrame:
    """Unconfirmed products with a readable photo."""
    return products.filter("NOT confirmed").join(photos.filter("readable").select("product_id"), "product_id", "left_semi")


def deleted_lots(lots: DataFrame, asked: DataFrame, sold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept lots, refused requests): a lot with any sale is refused; history of references is not touched."""
    refused = asked.join(sold.select("lot_id"), "lot_id", "left_semi")
    return lots.join(asked.join(refused, "lot_id", "left_anti"), "lot_id", "left_anti"), refused


def without_lots(tables: dict[str, DataFrame], asked: DataFrame, sold: DataFrame) -> dict[str, DataFrame]:
    """Every table of tables without the rows of lots that may be deleted; a table without a lot_id goes by product_id.

    tables holds lots and products and whatever hangs on either: photos, readings, fields, listings, seams, reviews.
    """
    gone = asked.join(sold.select("lot_id"), "lot_id", "left_anti").select("lot_id").distinct()
    products = tables["products"].join(gone, "lot_id", "left_semi").select("product_id").distinct()
    return {name: rows.join(gone, "lot_id", "left_anti") if "lot_id" in rows.columns else rows.join(products, "product_id", "left_anti") for name, rows in tables.items()}


def newest_lots(lots: DataFrame) -> DataFrame:
    """lots(lot_id, created_at, ...) newest first, undated ones last, ties by lot: a range sort, no single task."""
    return lots.orderBy(F.col("created_at").desc_nulls_last(), "lot_id")


def unknown_targets(commands: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """commands that name a key which entities lack, with a reason."""
    return commands.join(entities.select(key), key, "left_anti").withColumn("reason", F.lit(f"unknown_{key.removesuffix('_id')}"))


def lot_overview(lots: DataFrame, products: DataFrame, photos: DataFrame) -> DataFrame:
    """lots with photos, products, confirmed: counted apart before the joins, so no row is multiplied."""
    p = products.groupBy("lot_id").agg(F.count(F.lit(1)).alias("products"), F.count_if("confirmed").alias("confirmed"))
    f = photos.groupBy("lot_id").agg(F.count(F.lit(1)).alias("photos"))
    return lots.join(p, "lot_id", "left").join(f, "lot_id", "left").na.fill(0, ["photos", "products", "confirmed"])


def products_with_photos(products: DataFrame, photos: DataFrame) -> DataFrame:
    """products with photo_ids by time (undated first), then creation; no photo gives an empty list."""
    held = photos.filter("product_id IS NOT NULL").groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("captured_at").isNotNull().alias("dated"), "captured_at", "created_at", "photo_id"))), lambda x: x["photo_id"]).alias("photo_ids"))
    return products.join(held, "product_id", "left").withColumn("photo_ids", F.coalesce("photo_ids", F.expr("CAST(array() AS array<string>)")))
