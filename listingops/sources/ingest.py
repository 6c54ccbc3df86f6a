"""Reading raw inputs: photo folders, capture times, category snapshots, listing payloads, stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions.text import blank_to_null
from listingops.sources import dims


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def photo_files(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """path, length, modified_at and sha256 of photos below folder, by extension in any case; a missing folder is empty."""
    schema = "path string, length bigint, modified_at timestamp, sha256 string"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.filter(extension(F.col("path")).isin(*dims.PHOTO_EXTENSIONS))
    sha = F.sha2("content", 256) if with_content else F.lit(None).cast("string")
    return rows.select("path", "length", F.col("modificationTime").alias("modified_at"), sha.alias("sha256")).orderBy("path")


def fingerprints(photos: DataFrame) -> DataFrame:
    """photos(photo_id, content, content_error, phash, phash_error) with sha256, phash, error: either may fail alone."""
    sha = F.when(F.col("content_error").isNull(), F.sha2("content", 256))
    hash_ = F.when(F.col("phash_error").isNull(), F.col("phash"))
    return photos.select("photo_id", sha.alias("sha256"), hash_.alias("phash"), F.nullif(F.concat_ws("; ", "content_error", "phash_error"), F.lit("")).alias("error"))


def capture_time(raw: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS as a time; anything else is null, never a file time."""
    t = F.trim(raw)
    return F.when(t.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy:MM:dd HH:mm:ss")))


def registered(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects with reason) of photos(lot_id, folder, path, copied): a path outside its lot's folder, a
    failed copy, or a second row of the same path is rejected; unreadable photos are accepted."""
    norm = F.regexp_replace(F.regexp_replace("path", r"/\./", "/"), r"/+", "/")
    inside = norm.startswith(F.concat(F.regexp_replace("folder", r"/+$", ""), F.lit("/"))) & ~norm.rlike(r"(^|/)\.\.(/|$)")
    w = W.partitionBy("lot_id", "_norm").orderBy("path", "photo_id")
    rows = photos.withColumn("_norm", norm).withColumn("_inside", inside).withColumn("_n", F.row_number().over(w))
    reason = F.when(~F.coalesce("copied", F.lit(True)), "not_copied").when(~F.col("_inside"), "outside_folder").when(F.col("_n") > 1, "registered_before")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").select(*photos.columns), rows.filter("reason IS NOT NULL").select(*photos.columns, "reason")


def lot_counts(accepted: DataFrame, rejects: DataFrame) -> DataFrame:
    """lot_id, photos, unreadable, undated, undated_share, mostly_undated, rejected; the share is 0 for no photos."""
    a = accepted.groupBy("lot_id").agg(F.count(F.lit(1)).alias("photos"), F.count_if(~F.col("readable")).alias("unreadable"), F.count_if(F.col("captured_at").isNull()).alias("undated"))
    b = rejects.groupBy("lot_id").agg(F.count(F.lit(1)).alias("rejected"))
    rows = a.join(b, "lot_id", "full_outer").na.fill(0, ["photos", "unreadable", "undated", "rejected"])
    share = F.when(F.col("photos") > 0, 100.0 * F.col("undated") / F.col("photos")).otherwise(0.0)
    return rows.withColumn("undated_share", share).withColumn("mostly_undated", (F.col("photos") > 0) & (share >= 50))


def free_names(photos: DataFrame) -> DataFrame:
    """photos(lot_id, photo_id, path) with target: the base name, unique within its lot.

    The first file of a base name, by path and photo_id, keeps it; the others get the least numbers, _1, _2 ..., that
    make no base name of the lot. A number stands for one stem and extension only, so no two files get one name.
    """
    base = F.regexp_extract("path", r"([^/\\]+)$", 1)
    stem, ext = F.regexp_replace("_base", r"\.[^.]*$", ""), F.regexp_extract("_base", r"(\.[^.]*)$", 1)
    rows = photos.withColumn("_base", base).withColumn("_stem", stem).withColumn("_ext", ext)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("lot_id", "_base").orderBy("path", "photo_id")) - 1)
    numbered = rows.select("lot_id", F.regexp_extract("_stem", r"^(.*)_([1-9]\d{0,8})$", 1).alias("_stem"), F.regexp_extract("_stem", r"^(.*)_([1-9]\d{0,8})$", 2).try_cast("int").alias("_k"), "_ext").filter("_k IS NOT NULL")
    taken = numbered.groupBy("lot_id", "_stem", "_ext").agg(F.array_sort(F.collect_set("_k")).alias("_taken"))  # no more than a lot's names
    rows = rows.join(taken, ["lot_id", "_stem", "_ext"], "left")
    below = F.size(F.filter(F.transform(F.col("_taken"), lambda k, i: k - i - 1), lambda free: free < F.col("_n")))  # numbers taken up to the n-th free one
    number = F.col("_n") + F.when(F.col("_taken").isNull(), 0).otherwise(below)
    target = F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat("_stem", F.lit("_"), number.cast("string"), "_ext"))
    return rows.withColumn("target", target).select(*photos.columns, "target")


def snapshot_leaves(spark: SparkSession, path: str) -> DataFrame:
    """snapshot_date, leaf_id, name, path, root_id, leaf_mandatory of a category snapshot; a missing file is an error."""
    schema = "fecha string, hojas array<struct<id:bigint,nombre:string,ruta:array<string>,raiz_id:bigint,leaf_mandatory:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("fecha", F.explode("hojas").alias("h"))
    flag = F.coalesce(F.lower("h.leaf_mandatory").isin("true", "1"), F.lit(False))
    return rows.select(F.col("fecha").alias("snapshot_date"), F.col("h.id").alias("leaf_id"), F.col("h.nombre").alias("name"), F.col("h.ruta").alias("path"), F.col("h.raiz_id").alias("root_id"), flag.alias("leaf_mandatory"))


def price_of(item: Column) -> Column:
    """A listing's price: a number, or amount, cash or price of an object; booleans and texts are none."""

    def number(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(item, path, "variant"))
        return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL"), F.try_variant_get(item, path, "double"))

    return F.coalesce(*(number(p) for p in ("$.price", "$.price.amount", "$.price.cash", "$.price.price")))


def listings_of(payloads: DataFrame, base_url: str = "https://es.wallapop.com/item/") -> DataFrame:
    """query, rank, url, price, title of payloads(query, body): items of data.section.payload.items with a slug and a
    price above 0; rank is the place in the body. Bodies that are no JSON or hold no list give no rows."""
    parsed = payloads.select("query", F.try_parse_json("body").alias("v"))
    items = parsed.select("query", F.expr("try_variant_get(v, '$.data.section.payload.items', 'array<variant>')").alias("items"))
    rows = items.select("query", F.posexplode("items").alias("rank", "item"))
    slug = F.try_variant_get("item", "$.web_slug", "string")
    out = rows.select("query", "rank", blank_to_null(slug).alias("slug"), price_of(F.col("item")).alias("price"), F.try_variant_get("item", "$.title", "string").alias("title"))
    return out.filter("slug IS NOT NULL AND price > 0").select("query", "rank", F.concat(F.lit(base_url), "slug").alias("url"), "price", "title")


FIELD = "struct<valor:string,fuente:string,confianza:string,evidencia:struct<fichero:string,bbox:array<int>>>"


def stored_fields(products: DataFrame) -> DataFrame:
    """product_id, field, value, source, confidence, photo, box of products(product_id, fields_json).

    Fields without a value, with an unobserved source or with bad evidence are null rows' absence: they are left out.
    """
    parsed = products.select("product_id", F.from_json(F.get_json_object("fields_json", "$.campos"), f"map<string,{FIELD}>").alias("m"))
    rows = parsed.select("product_id", F.explode("m").alias("field", "f")).select("product_id", "field", F.col("f.valor").alias("value"), F.col("f.fuente").alias("source"), F.coalesce("f.confianza", F.lit("baja")).alias("confidence"), F.col("f.evidencia.fichero").alias("photo"), F.col("f.evidencia.bbox").alias("box"))
    box_ok = F.col("box").isNull() | ((F.size("box") == 4) & F.forall("box", lambda x: x >= 0))
    good = F.col("value").isNotNull() & F.col("source").isin(*dims.SEARCHABLE_SOURCES) & box_ok & ((F.col("source") != "foto") | blank_to_null(F.col("photo")).isNotNull()) & F.col("confidence").isin(*dims.CONFIDENCES)
    return rows.filter(good)


def stored_json(fields: DataFrame) -> DataFrame:
    """product_id, fields_json of fields: the writer that stored_fields reads."""
    one = F.struct(F.col("value").alias("valor"), F.col("source").alias("fuente"), F.col("confidence").alias("confianza"), F.struct(F.col("photo").alias("fichero"), F.col("box").alias("bbox")).alias("evidencia"))
    return fields.groupBy("product_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", one.alias("f"))), lambda a, b: F.when(a["field"] < b["field"], -1).when(a["field"] > b["field"], 1).otherwise(0))).alias("m")).select("product_id", F.to_json(F.struct(F.col("m").alias("campos"))).alias("fields_json"))


def reading_rows(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, rejects) of payloads(product_id, seq, photo, raw_ocr, body): one row for each finding.

    A body needs legible, belongs, location and a non-empty list of findings with known codes; an illegible one has no
    text.
    """
    schema = "legible boolean, belongs boolean, location string, findings array<struct<content:string,text:string>>"
    rows = payloads.withColumn("p", F.from_json("body", schema))
    ok = F.col("p.legible").isNotNull() & F.col("p.belongs").isNotNull() & F.coalesce(F.col("p.location").isin(*dims.LOCATIONS), F.lit(False)) & (F.size("p.findings") > 0) & F.forall("p.findings", lambda f: f["content"].isin(*dims.CONTENTS))
    rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = rows.filter("_ok").select("product_id", "seq", "photo", "raw_ocr", "p.legible", "p.belongs", "p.location", F.explode("p.findings").alias("f"))
    text = F.when(F.col("legible"), blank_to_null(F.col("f.text")))
    return good.select("product_id", "seq", "photo", "raw_ocr", "legible", "belongs", "location", F.col("f.content").alias("content"), text.alias("text")), rows.filter("NOT _ok").select("product_id", "seq", F.lit("invalid_payload").alias("reason"))


def synthesis_rows(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of payloads(product_id, body): product_id, field, value, visible, cited_text, confidence.

    body is an object of field objects; blanks become null; a confidence other than media or baja, or no object at all,
    rejects the row.
    """
    one = "struct<value:string,visible:boolean,cited_text:string,confidence:string>"
    parsed = payloads.select("product_id", F.from_json("body", f"map<string,{one}>").alias("m"))
    rows = parsed.select("product_id", F.explode_outer("m").alias("field", "f")).select("product_id", "field", blank_to_null(F.col("f.value")).alias("value"), F.coalesce("f.visible", F.lit(False)).alias("visible"), blank_to_null(F.col("f.cited_text")).alias("cited_text"), F.col("f.confidence").alias("confidence"))
    ok = F.col("field").isNotNull() & F.coalesce(F.col("confidence").isin("media", "baja"), F.lit(False))
    return rows.filter(ok), rows.filter(~ok).select("product_id", "field", F.lit("invalid_synthesis").alias("reason"))
