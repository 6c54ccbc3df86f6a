"""Checking, reviewing and exporting listings.

fields: product_id, field, value, source, confidence, photo, box. listings hold one row per product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions import text as T
from listingops.operators.dealing import dealt
from listingops.sources import dims

NONE = "CAST(array() AS array<string>)"


def field_violations(source: Column, confidence: Column, photo: Column, box: Column) -> Column:
    """Codes of the provenance rules that a field breaks. box: struct<x,y,w,h> or null."""
    sides = reduce(lambda a, b: a | b, (F.coalesce(box[s] < 0, box.isNotNull()) for s in ("x", "y", "w", "h")))
    rules = (
        ("bad_source", ~F.coalesce(source.isin(*dims.SOURCES), F.lit(False))),
        ("bad_confidence", ~F.coalesce(confidence.isin(*dims.CONFIDENCES), F.lit(False))),
        ("photo_without_evidence", F.coalesce(source == "foto", F.lit(False)) & photo.isNull()),
        ("blank_file", F.coalesce(F.trim(photo) == "", F.lit(False))),
        ("bad_box", F.coalesce(sides, F.lit(False))),
    )
    return F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules)))


def split_valid(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with violations)."""
    rows = fields.withColumn("violations", field_violations(F.col("source"), F.col("confidence"), F.col("photo"), F.col("box")))
    return rows.filter(F.size("violations") == 0).drop("violations"), rows.filter(F.size("violations") > 0)


def text_violations(texts: DataFrame) -> DataFrame:
    """texts(text_id, platform, field, brand, text) with codes, exportable, n, most, within (the length counter)."""
    limits = F.broadcast(dims.limits(texts.sparkSession))
    rows = texts.join(limits, ["platform", "field"])
    codes = T.violations(F.col("text"), F.col("least"), F.col("most"), F.col("brand"))
    n = F.length("text")
    return rows.withColumn("codes", codes).select(*texts.columns, "codes", (F.size("codes") == 0).alias("exportable"), n.alias("n"), "most", (n <= F.col("most")).alias("within"))


def mapped_conditions(choices: DataFrame) -> DataFrame:
    """choices(product_id, category, choice) for each platform: level, literal; unknown choices give null, never a guess."""
    spark = choices.sparkSession
    rows = choices.withColumn("_c", F.trim("choice")).join(F.broadcast(dims.choices(spark).withColumnRenamed("choice", "_c")), "_c", "left").drop("_c")
    places = F.broadcast(spark.createDataFrame([(p,) for p in dims.PLATFORMS], "platform string"))
    rows = rows.crossJoin(places)  # two rows each
    return rows.join(F.broadcast(condition_fidelity(dims.conditions(spark)).drop("code")), ["platform", "category", "level"], "left")


def condition_fidelity(conditions: DataFrame) -> DataFrame:
    """conditions with communicated (best level that shares the literal) and note: overstated by two levels or more,
    broken_as_working where the broken level shares its literal with a working one, else null (safe)."""
    w = W.partitionBy("platform", "category", "literal")
    rows = conditions.withColumn("communicated", F.min("level").over(w))
    shares = F.min("level").over(w) < dims.BROKEN_LEVEL
    note = F.when(F.col("level") - F.col("communicated") >= 2, "overstated").when((F.col("level") == dims.BROKEN_LEVEL) & shares, "broken_as_working")
    return rows.withColumn("note", note)


def with_required(fields: DataFrame, failures: DataFrame) -> DataFrame:
    """fields with an empty row for each required field a product lacks; the reason says whether its synthesis failed.

    failures: product_id, failure. A failure text that starts with vlm_sintesis: counts. Fields and failures of a product
    meet in one aggregate of flags, without a join: Spark takes made-up rows for fewer bytes than they have and would
    broadcast them.
    """
    marks = fields.select("product_id", "field", F.lit(True).alias("own"), F.lit(False).alias("failed"))
    marks = marks.unionByName(failures.select(F.col("product_id").cast(fields.schema["product_id"].dataType).alias("product_id"), F.lit(None).cast("string").alias("field"), F.lit(False).alias("own"), F.col("failure").startswith("vlm_sintesis:").alias("failed")))
    held = marks.groupBy("product_id").agg(F.max("own").alias("own"), F.max("failed").alias("failed"), *(F.max(F.coalesce(F.col("field") == f, F.lit(False))).alias(f"has_{f}") for f in dims.REQUIRED_FIELDS)).filter("own")
    missing = held.select("product_id", "failed", F.explode(F.array_compact(F.array(*(F.when(~F.col(f"has_{f}"), F.lit(f)) for f in dims.REQUIRED_FIELDS)))).alias("field"))
    empty = missing.select("product_id", "field", F.lit(None).cast("string").alias("value"), F.lit("inferido").alias("source"), F.lit("baja").alias("confidence"), F.when(F.coalesce("failed", F.lit(False)), "synthesis_failed").otherwise("older_version").alias("reason"))
    have = fields.select("product_id", "field", "value", "source", "confidence", (F.col("reason") if "reason" in fields.columns else F.lit(None).cast("string")).alias("reason"))
    return have.unionByName(empty)


def apply_review(fields: DataFrame, edits: DataFrame, warnings: DataFrame, block: bool = False) -> DataFrame:
    """Confirmed fields: product_id, field, value, source, confidence, touched.

    edits(product_id, field, value) are what the reviewer left in the form; a field without an edit keeps its value.
    One by one, every field becomes the reviewer's; in a block only touched ones do. Confidence: baja for null, media
    for products of warnings(product_id), else alta.
    """
    given = edits.select("product_id", "field", T.blank_to_null(F.col("value")).alias("_new"), F.lit(True).alias("_edit"))
    warned = warnings.select("product_id").distinct().withColumn("_warn", F.lit(True))
    rows = fields.join(given, ["product_id", "field"], "left").join(warned, "product_id", "left")
    edited = F.coalesce("_edit", F.lit(False))
    old = T.blank_to_null(F.col("value"))
    new = F.when(edited, F.col("_new")).otherwise(old)
    touched = edited & ~F.col("_new").eqNullSafe(old)
    own = touched if block else F.lit(True)
    level = F.when(new.isNull(), "baja").when(F.coalesce("_warn", F.lit(False)), "media").otherwise("alta")
    return rows.select("product_id", "field", new.alias("value"), F.when(own, "reviewer").otherwise(F.col("source")).alias("source"), F.when(own, level).otherwise(F.col("confidence")).alias("confidence"), touched.alias("touched"))


def pivoted(fields: DataFrame) -> DataFrame:
    """product_id and one column for each field that export and gates read."""
    names = ("titulo", "descripcion", "categoria", "estado", "marca", "talla", "modelo", "tipo", "genero", "color", "composicion", "desperfectos", "ean", "medidas")
    return dealt(fields, "product_id").groupBy("product_id").agg(*(F.max(F.when(F.col("field") == n, T.blank_to_null(F.col("value")))).alias(n) for n in names), F.array_sort(F.collect_set(F.when(F.col("source") == "inferido", F.col("field")))).alias("unreviewed"))


def missing_required(wide: DataFrame) -> DataFrame:
    """wide with missing: the required fields that are null, in form order."""
    return wide.withColumn("missing", F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in dims.REQUIRED_FIELDS))))


def ready_and_skipped(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = missing_required(wide)
    return rows.filter(F.size("missing") == 0), rows.filter(F.size("missing") > 0)


def content_problems(wide: DataFrame) -> DataFrame:
    """product_id, problems: codes of title and description on either platform but for lengths."""
    texts = F.array(*(F.struct(F.lit(p).alias("platform"), F.lit(f).alias("field"), F.col(c).alias("text")) for p in dims.PLATFORMS for f, c in (("title", "titulo"), ("description", "descripcion"))))
    rows = wide.select("product_id", F.col("marca").alias("brand"), F.explode(texts).alias("t")).select("product_id", "brand", "t.*").filter("text IS NOT NULL")
    found = text_violations(rows.withColumn("text_id", F.col("product_id"))).select("product_id", F.col("field"), F.explode("codes").alias("code")).filter(~F.col("code").isin("TOO_SHORT", "TOO_LONG"))
    return found.groupBy("product_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "field", "code"))).alias("problems"))


def confirm_listings(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons): the required gate, then the content rules; lengths do not block."""
    rows = missing_required(wide).join(content_problems(wide), "product_id", "left")
    reasons = F.concat(F.transform("missing", lambda m: F.concat(F.lit("missing:"), m)), F.coalesce("problems", F.expr(NONE)))
    rows = rows.withColumn("reasons", reasons).drop("missing", "problems")
    return rows.filter(F.size("reasons") == 0).drop("reasons"), rows.filter(F.size("reasons") > 0)


def run_report(done: DataFrame, failed: DataFrame) -> DataFrame:
    """product_id, ok, reason of a batch: a bad product is a row, it stops nothing."""
    return done.select("product_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason")).unionByName(failed.select("product_id", F.lit(False).alias("ok"), F.array_join("reasons", "; ").alias("reason")))


def apply_redaction(wide: DataFrame, texts: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated, rejected): texts(product_id, new_title, new_description) replace what the reviewer has not edited.

    edited(product_id, field) names fields the reviewer typed. A field that nobody edited and no text replaces rejects
    its product. The title is led by the type, the description mentions the defect.
    """
    own = edited.groupBy("product_id").agg(F.max(F.col("field") == "titulo").alias("_t"), F.max(F.col("field") == "descripcion").alias("_d"))
    rows = wide.join(texts.hint("merge"), "product_id", "left").join(own.hint("merge"), "product_id", "left")
    keep_t, keep_d = F.coalesce("_t", F.lit(False)), F.coalesce("_d", F.lit(False))
    title = T.led_by_type(T.blank_to_null(F.col("new_title")), F.col("tipo"))
    description = T.with_defect(T.blank_to_null(F.col("new_description")), F.col("desperfectos"))
    rows = rows.withColumn("_ok", (keep_t | title.isNotNull()) & (keep_d | description.isNotNull()))
    out = rows.withColumn("titulo", F.when(keep_t, F.col("titulo")).otherwise(title)).withColumn("descripcion", F.when(keep_d, F.col("descripcion")).otherwise(description))
    return out.filter("_ok").select(*wide.columns), rows.filter("NOT _ok").select("product_id", F.array(F.lit("no_text")).alias("reasons"))


def redaction_requests(wide: DataFrame, edited: DataFrame) -> DataFrame:
    """product_id, prompt: confirmed fields as labelled lines, of products with an unedited title or description."""
    done = edited.filter(F.col("field").isin("titulo", "descripcion")).groupBy("product_id").agg(F.count_distinct("field").alias("n")).filter("n = 2")
    lines = F.concat_ws("\n", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c))) for c in ("tipo", "genero", "marca", "modelo", "talla", "color", "estado", "composicion", "medidas", "desperfectos")))
    return wide.join(done, "product_id", "left_anti").select("product_id", lines.alias("prompt"))


# -- payloads --------------------------------------------------------------------------------------------------------


def _field(name: str, label: Column | str, value: Column, translated: Column, note: Column | None = None) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(F.lit(name).alias("name"), label.alias("label"), value.alias("value"), translated.alias("translated"), (F.lit(None).cast("string") if note is None else note).alias("note"))


def build_payload(confirmed: DataFrame, photos: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(payloads, blocked): one row per product and platform.

    confirmed: pivoted listings with confirmed, reference, coherence_warning, photos. photos: photo_id, path.
    candidates: product_id, platform, rank, leaf_id, name. Blocked rows carry reasons: not confirmed, text rules, unknown
    category.
    """
    spark = confirmed.sparkSession
    places = F.broadcast(spark.createDataFrame([(p,) for p in dims.PLATFORMS], "platform string"))
    rows = confirmed.withColumn("title", F.coalesce("titulo", F.lit(""))).withColumn("description", T.stamped(F.coalesce("descripcion", F.lit("")), F.col("reference")))
    rows = rows.withColumns({f"_{c}_codes": T.content_codes(F.col(c), F.col("marca")) for c in ("title", "description")})  # once for all platforms
    rows = rows.crossJoin(places)  # two rows each
    limits = F.broadcast(dims.limits(spark).groupBy("platform").pivot("field", ["title", "description"]).agg(F.first("least").alias("least"), F.first("most").alias("most")))
    rows = rows.join(limits, "platform")
    code = lambda field: F.transform(T.with_length_codes(F.col(f"_{field}_codes"), F.col(field), F.col(f"{field}_least"), F.col(f"{field}_most")), lambda c: F.concat(F.lit(f"{field}:"), c))
    blocks = F.concat(F.when(F.coalesce("confirmed", F.lit(False)), F.expr(NONE)).otherwise(F.array(F.lit("not_confirmed"))), code("title"), code("description"), F.when(F.coalesce(F.col("categoria").isin(*dims.CATEGORIES), F.lit(False)), F.expr(NONE)).otherwise(F.array(F.lit("unknown_category"))))
    rows = rows.withColumn("reasons", blocks)
    blocked = rows.filter(F.size("reasons") > 0).select("product_id", "platform", "reasons")
    rows = rows.filter(F.size("reasons") == 0)
    levels = F.broadcast(condition_fidelity(dims.conditions(spark)).join(dims.choices(spark), "level").select("platform", F.col("category").alias("categoria"), F.col("choice").alias("estado"), "literal", F.col("note").alias("fidelity")))
    rows = rows.join(levels, ["platform", "categoria", "estado"], "left")
    vinted = F.col("platform") == "vinted"
    yes, no = F.lit(True), F.lit(False)
    fields = F.array_compact(F.array(
        _field("marca", F.when(vinted, "brand").otherwise("marca"), F.when(vinted, F.coalesce("marca", F.lit("Sin marca"))).otherwise(F.col("marca")), vinted | F.col("marca").isNotNull(), F.when(vinted & F.col("marca").isNull(), "no brand read or confirmed")),
        _field("talla", F.when(vinted, "size_id").otherwise("size"), F.col("talla"), no, F.when(vinted, "pick the size by hand").otherwise("compose the size by hand")),
        _field("estado", F.when(vinted, "status_id").otherwise("estado"), F.col("literal"), F.col("literal").isNotNull() & F.col("fidelity").isNull(), F.col("fidelity")),
        _field("envio", F.when(vinted, "package_size").otherwise("tramo_peso_kg"), T.shipping_value(F.concat_ws(" ", "title", "descripcion"), F.col("platform")), no, F.lit("suggested, rather too large")),
        F.when(F.col("color").isNotNull(), _field("color", "color", F.col("color"), no, F.lit("pick from the platform's list"))),
        F.when(F.col("composicion").isNotNull() & ~((F.col("platform") == "wallapop") & (F.col("categoria") == "moda")), _field("composicion", "material", F.col("composicion"), no, F.lit("pick from the platform's list"))),
        F.when(F.col("desperfectos").isNotNull(), _field("desperfectos", "desperfectos", F.col("desperfectos"), no, F.lit("must stand in the description"))),
    ))
    uncovered = dims.fields(spark).filter("required AND NOT covered").groupBy("platform").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field"))), lambda x: F.concat(F.lit("required:"), x["field"])).alias("_uncovered"))
    rows = rows.join(F.broadcast(uncovered), "platform")
    warnings = F.concat(F.array_compact(F.array(
        F.when(F.col("coherence_warning").isNotNull(), "coherence"),
        F.when(F.size("unreviewed") > 0, F.concat(F.lit("unreviewed:"), F.size("unreviewed").cast("string"), F.lit(":"), F.array_join("unreviewed", ","))),
        F.when(~vinted & F.col("marca").isNull(), "no_brand"), F.when(F.col("talla").isNull(), "no_size"), F.when(F.col("literal").isNull(), "no_condition"),
        F.when(F.col("fidelity").isNotNull(), F.concat(F.lit("condition:"), "fidelity")), F.when(F.col("desperfectos").isNotNull(), "check_defect"),
    )), F.col("_uncovered"))
    out = rows.select("product_id", "platform", "title", "description", "photos", fields.alias("fields"), warnings.alias("warnings"))
    # photos meet their paths once a product; merged, as Spark takes exploded rows for fewer bytes than they have and would broadcast them
    held = dealt(confirmed.select("product_id", F.posexplode("photos").alias("pos", "photo_id")), "photo_id").join(photos.filter("path IS NOT NULL").hint("merge"), "photo_id", "left")
    found = dealt(held, "product_id").groupBy("product_id").agg(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("pos", "path")))).alias("_paths"), F.count_if(F.col("path").isNull()).alias("unknown_photos"))
    out = out.drop("photos").join(found.hint("merge"), "product_id", "left")
    limit = F.when(F.col("platform") == "wallapop", dims.PHOTO_LIMITS["wallapop"]).otherwise(dims.PHOTO_LIMITS["vinted"])
    paths = lambda c: F.coalesce(F.transform(F.filter("_paths", c), lambda x: x["path"]), F.expr(NONE))
    out = out.withColumns({"included": paths(lambda x: x["pos"] < limit), "excluded": paths(lambda x: x["pos"] >= limit)}).select(*(c for c in out.columns if c not in ("_paths", "unknown_photos")), "included", "excluded", "unknown_photos")
    extra = F.array_compact(F.array(F.when(F.size("included") == 0, "no_photos"), F.when(F.size("excluded") > 0, F.concat(F.lit("over_photo_limit:"), F.size("excluded").cast("string"))), F.when(F.col("unknown_photos") > 0, "unknown_photos")))
    out = out.withColumn("warnings", F.concat("warnings", extra))
    if candidates is None:
        return out.withColumn("warnings", F.concat("warnings", F.array(F.lit("no_category_tree")))).withColumn("candidates", F.expr("CAST(array() AS array<struct<rank:int,leaf_id:bigint,name:string>>)")), blocked
    leaves = candidates.groupBy("product_id", "platform").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("leaf_id").cast("long").alias("leaf_id"), "name"))).alias("candidates"))
    return out.join(leaves, ["product_id", "platform"], "left"), blocked


def payload_blocks(payloads: DataFrame) -> DataFrame:
    """product_id, platform, pos, block: what each payload holds, in the order of the platform's form."""
    special = F.array(*(F.lit(b) for b in ("resumen", "fotos", "categoria", "titulo_desc", "precio")))
    names = F.concat(special, F.transform("fields", lambda f: F.when(f["name"] == "envio", f["label"]).otherwise(f["name"])))
    rows = payloads.select("product_id", "platform", F.explode(names).alias("block"))
    return rows.join(F.broadcast(dims.block_order(payloads.sparkSession)), ["platform", "block"]).select("product_id", "platform", "pos", "block")


# -- queues and labels -----------------------------------------------------------------------------------------------


def queue_flags(products: DataFrame) -> DataFrame:
    """products(product_id, fields_json) with extracted and confirmed, from the content only; corrupt JSON is neither."""
    extracted = F.get_json_object("fields_json", "$.campos").isNotNull()
    confirmed = F.coalesce(F.get_json_object("fields_json", "$.confirmada") == "true", F.lit(False))
    return products.withColumn("extracted", extracted).withColumn("confirmed", confirmed)


def work_queues(flagged: DataFrame) -> DataFrame:
    """flagged with queue: extract, confirm or done."""
    return flagged.withColumn("queue", F.when(~F.col("extracted"), "extract").when(~F.col("confirmed"), "confirm").otherwise("done"))


def stored_title(fields_json: Column) -> Column:
    """The title of a stored listing, nested or flat; null for corrupt JSON and anything that is no text."""
    nested, flat = F.get_json_object(fields_json, "$.campos.titulo.valor"), F.get_json_object(fields_json, "$.titulo.valor")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(fields_json), path, "variant"))
    return F.coalesce(F.when(kind("$.campos.titulo.valor") == "STRING", nested), F.when(kind("$.titulo.valor") == "STRING", flat))


def lot_label(name: Column, photos: Column, confirmed: Column, products: Column) -> Column:
    return F.format_string("%s (%d photos, %d/%d)", name, photos, confirmed, products)


def product_label(product_id: Column, title: Column, brand: Column, photos: Column, confirmed: Column) -> Column:
    mark = F.when(confirmed, " ok").otherwise("")
    return F.concat(F.substring(product_id.cast("string"), 1, 8), F.lit(" "), F.coalesce(T.blank_to_null(title), T.blank_to_null(brand), F.lit("?")), F.format_string(" (%d)", photos), mark)


def default_value(value: Column, readings: Column) -> Column:
    """A field's value, else its first non-empty reading."""
    return F.coalesce(T.blank_to_null(value), F.get(F.filter(readings, lambda t: F.trim(t) != ""), F.lit(0)))


def relaxed_query(wide: DataFrame) -> DataFrame:
    """product_id, terms: brand, model, EAN and size of any source, for looking at comparables while reviewing."""
    return wide.select("product_id", F.concat_ws(" ", "marca", "modelo", "ean", "talla").alias("terms"))


def curation_progress(groups: DataFrame, products: DataFrame) -> DataFrame:
    """lot_id, pending, confirmed: open groups plus confirmed products of a lot."""
    a = groups.groupBy("lot_id").agg(F.count(F.lit(1)).alias("pending"))
    b = products.filter("confirmed").groupBy("lot_id").agg(F.count(F.lit(1)).alias("confirmed"))
    return a.join(b, "lot_id", "full_outer").na.fill(0, ["pending", "confirmed"])
