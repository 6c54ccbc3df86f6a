"""Domain tables made from the given tables, so that every operator runs over whole tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.operators.dealing import dealt
from listingops.sources import dims

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lot is a user's events: errors are unreadable photos, signups undated ones."""
    e = table(spark, sf_dir, "events")
    dated = ~F.col("event_type").isin("signup", "error")
    return e.select(
        F.col("user_id").alias("lot_id"), F.col("event_id").alias("photo_id"), F.format_string("IMG_%09d.jpg", "event_id").alias("name"),
        F.when(dated, F.col("ts").cast("timestamp")).alias("captured_at"), (F.col("event_type") != "error").alias("readable"),
        F.when(F.col("event_type") == "error", "bad file").alias("read_error"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fields of each part; sources vary with the key so that some are not observed."""
    p = table(spark, sf_dir, "part")
    source = lambda m: F.when(F.col("p_partkey") % m == 0, "inferido").when(F.col("p_partkey") % 2 == 0, "reviewer").otherwise("foto")
    rows = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value"), source(m).alias("source")) for f, v, m in (("marca", F.col("p_brand"), 5), ("modelo", F.col("p_name"), 3), ("tipo", F.col("p_type"), 7), ("talla", F.col("p_size").cast("string"), 11))))
    return p.select(F.col("p_partkey").alias("product_id"), F.explode(rows).alias("x")).select("product_id", "x.*")


def comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listings of their part's brand and type, ranked by order and line."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5) / 100
    return rows.select(F.concat_ws(" ", "p_brand", "p_type").alias("query"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("url"), price.alias("price"), F.col("p_name").alias("title"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product events of line items by part: every line is published and sold; R lines are returned, A lines undone at
    times. The retail price is the cost, set before all. seq is the line's place among its part's lines, by all columns,
    as order and line repeat within a part."""
    order = W.partitionBy("l_partkey").orderBy(*LINE_ORDER)
    l_ = dealt(table(spark, sf_dir, "lineitem"), "l_partkey").withColumn("_place", F.row_number().over(order).cast("long"))
    at = F.col("l_shipdate").cast("timestamp")
    base = F.col("_place") * 4
    platform = F.when(F.col("l_suppkey") % 2 == 0, "vinted").otherwise("wallapop")
    price = F.rint(F.col("l_extendedprice") * 100).cast("long")
    after = F.when(F.col("l_returnflag") == "R", "returned").when((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 3 == 0), "undo_sale")
    made = F.array(
        F.struct(base.alias("seq"), F.lit("published").alias("type")), F.struct((base + 1).alias("seq"), F.lit("sold").alias("type")),
        F.struct((base + 2).alias("seq"), after.alias("type")),
    )
    rows = l_.select(F.col("l_partkey").alias("product_id"), at.alias("at"), platform.alias("platform"), price.alias("price_cents"), F.when(F.col("l_linenumber") == 2, F.col("l_orderkey")).alias("bundle_id"), F.explode(made).alias("x")).filter("x.type IS NOT NULL")
    rows = rows.select("product_id", "x.seq", "at", "x.type", F.when(F.col("x.type").isin("published", "sold"), F.col("platform")).alias("platform"), F.when(F.col("x.type").isin("published", "sold"), F.col("price_cents")).alias("price_cents"), F.lit(None).cast("long").alias("cost_cents"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("reference"), F.when(F.col("x.type") == "sold", F.col("bundle_id")).alias("bundle_id"), F.lit(None).cast("timestamp").alias("sold_at"))
    p = table(spark, sf_dir, "part")
    cost = p.select(F.col("p_partkey").alias("product_id"), F.lit(-1).cast("long").alias("seq"), F.lit("1990-01-01").cast("timestamp").alias("at"), F.lit("cost").alias("type"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("long").alias("price_cents"), F.rint(F.col("p_retailprice") * 100).cast("long").alias("cost_cents"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("reference"), F.lit(None).cast("long").alias("bundle_id"), F.lit(None).cast("timestamp").alias("sold_at"))
    return rows.unionByName(cost)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as descriptions on either platform by parity; every third has a brand."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("text_id"), F.when(F.col("doc_id") % 2 == 0, "vinted").otherwise("wallapop").alias("platform"), F.lit("description").alias("field"), F.when(F.col("doc_id") % 3 == 0, "Nike").alias("brand"), "text")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as label readings, whole: turn and length set place, content and legibility."""
    c = table(spark, sf_dir, "conversations")
    places = F.array(*(F.lit(x) for x in ("etiqueta_interior", "estampado_o_grafico", "codigo_o_modelo_impreso")))
    contents = F.array(*(F.lit(x) for x in ("marca", "talla", "modelo")))
    return c.select(F.col("conv_id").alias("product_id"), F.col("turn").cast("long").alias("seq"), F.concat(F.lit("f"), (F.col("turn") % 2).cast("string"), F.lit(".jpg")).alias("photo"), F.lit(None).cast("struct<x:int,y:int,w:int,h:int>").alias("box"), (F.length("text") % 5 != 0).alias("legible"), F.lit(True).alias("belongs"), F.get(places, (F.length("text") % 3).cast("int")).alias("location"), F.get(contents, (F.col("turn") % 3).cast("int")).alias("content"), "text", F.lit(None).cast("string").alias("raw_ocr"), F.lit("vlm").alias("origin"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names below brand below type, one tree for each platform."""
    p = table(spark, sf_dir, "part")
    rows = p.groupBy("p_type", "p_brand", "p_name").agg(F.min("p_partkey").alias("leaf_id"))
    places = spark.createDataFrame([("vinted",), ("wallapop",)], "platform string")
    return rows.crossJoin(F.broadcast(places)).select("platform", "leaf_id", F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("path"), F.lit(0).alias("root_id"))


def type_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category tree of bounded size: part names below part types, one tree for each platform."""
    rows = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("leaf_id"))
    places = spark.createDataFrame([("vinted",), ("wallapop",)], "platform string")
    return rows.crossJoin(F.broadcast(places)).select("platform", "leaf_id", F.col("p_name").alias("name"), F.array(F.lit("parts"), "p_type").alias("path"), F.lit(0).alias("root_id"))


AUDIENCES = ("Mujer", "Hombre", "Infantil", "Casa")
TREE_ROOTS = {p: tuple(r for (q, _), ids in dims.ROOTS.items() if q == p for r in ids) + dims.CHILD_ROOTS[p] + (999,) for p in dims.PLATFORMS}


def rooted_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names below types below an audience, under the platforms' own roots in turn."""
    rows = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("leaf_id"))
    places = F.explode(F.array(*(F.struct(F.lit(p).alias("platform"), F.array(*map(F.lit, ids)).alias("ids")) for p, ids in TREE_ROOTS.items())))
    each = rows.select("*", places.alias("x"))
    audience = F.get(F.array(*map(F.lit, AUDIENCES)), (F.length("p_type") % len(AUDIENCES)).cast("int"))
    root = F.get(F.col("x.ids"), (F.length("p_name") % F.size("x.ids")).cast("int"))
    return each.select(F.col("x.platform").alias("platform"), "leaf_id", F.col("p_name").alias("name"), F.array(F.lit("catalogo"), audience, "p_type").alias("path"), root.alias("root_id"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as photo hashes: the signs of a vector's first twelve components make the content, sixty-four the picture.

    Bits say whether a component is above 0; every seventh vector has a copy one bit away.
    """
    e = table(spark, sf_dir, "embeddings")
    signs = F.transform("embedding", lambda v: F.when(v > 0, "1").otherwise("0"))
    bits = F.conv(F.conv(F.array_join(signs, ""), 2, 16), 16, -10).cast("long")
    own = e.select(F.col("vec_id").alias("photo_id"), F.array_join(F.slice(signs, 1, 12), "").alias("sha256"), bits.alias("bits"))
    return own.unionByName(own.filter(F.col("photo_id") % 7 == 0).select((F.col("photo_id") + 1_000_000_000).alias("photo_id"), "sha256", F.col("bits").bitwiseXOR(F.lit(1).cast("long")).alias("bits")))
