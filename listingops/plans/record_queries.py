"""Queries over records and their upkeep: saved proposals, seam logs, reasons, checked payloads, state from events, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.functions import text as T
from listingops.operators import evals, grouping, ledger, listings, readings, usage
from listingops.plans.listing_queries import _CHOICE, _COND, FIELDS, READINGS, _fields, _heavy, _light, _payloads, _regions
from listingops.plans.photo_queries import ASSIGNED, GAP_S, GROUPED, PHOTOS, PROPOSAL, _assignment, _proposal
from listingops.plans.registry import SQL, query
from listingops.plans.sales_queries import LEDGER, LOTS, VARIANTS, _lots, _products, _state, ean_checks
from listingops.sources import derived, dims, ingest

# -- proposals -------------------------------------------------------------------------------------------------------


@query(GROUPED + f"""
SELECT lot_id, group_key, CASE WHEN section = 'undated' THEN 'no capture time' WHEN section = 'unreadable' THEN 'unreadable: bad file' WHEN max(most) = 0 THEN 'all dated photos have the same time'
  WHEN max(n) = 1 THEN 'the only dated photo of the lot' WHEN count(*) = 1 THEN 'one photo between two gaps'
  ELSE count(*) || ' photos in ' || format('{{:.0f}}', (max(t) - min(t)) / 1e6) || ' s, largest gap ' || format('{{:.0f}}', coalesce(max(gap), 0.0)) || ' s, cut at {GAP_S:.0f} s' END AS reason
FROM grp GROUP BY lot_id, section, group_key
""")
def group_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that tells a reviewer why a group was proposed."""
    return grouping.group_photos(derived.photos(spark, sf_dir), GAP_S).select("lot_id", "group_key", "reason")


@query(PROPOSAL.split("SELECT lot_id, rule, item FROM (")[0].replace("known AS (SELECT p.*", "own AS (SELECT * FROM prop WHERE lot_id % 2 = 0 UNION ALL SELECT lot_id, photo_id % 7, photo_id FROM base WHERE lot_id % 2 = 1 AND readable AND NOT confirmed),\nknown AS (SELECT p.*").replace("FROM prop p LEFT JOIN", "FROM own p LEFT JOIN") + """
, bad AS (
  SELECT lot_id FROM own WHERE photo_id IS NULL UNION SELECT lot_id FROM own WHERE photo_id IS NOT NULL GROUP BY lot_id, photo_id HAVING count(DISTINCT group_id) > 1
  UNION SELECT lot_id FROM known WHERE readable IS NULL OR confirmed UNION SELECT lot_id FROM known WHERE readable IS NOT NULL GROUP BY lot_id, group_id HAVING count(*) > 1 AND count(*) FILTER (NOT readable) > 0)
SELECT lot_id, group_id, photo_id FROM own WHERE lot_id NOT IN (SELECT lot_id FROM bad)
""")
def accepted_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposals of lots in which nothing is wrong: those of odd lots are sound, the others are those of proposal_checks."""
    proposal, base = _proposal(spark, sf_dir)
    sound = base.filter((F.col("lot_id") % 2 == 1) & F.col("readable") & ~F.col("confirmed")).select("lot_id", (F.col("photo_id") % 7).alias("group_id"), "photo_id")
    return grouping.accepted_proposals(proposal.filter(F.col("lot_id") % 2 == 0).unionByName(sound), base)


@query(LOTS + """
, cur AS (SELECT ph.lot_id, photo_id, 'p' || product_id AS product_id, confirmed FROM ph JOIN pr USING (product_id)),
new AS (SELECT lot_id, photo_id, 'n' || photo_id % 7 AS product_id FROM cur WHERE lot_id % 3 <> 0 AND photo_id % 4 <> 0),
kept AS (SELECT * FROM cur WHERE confirmed OR lot_id NOT IN (SELECT lot_id FROM new))
SELECT lot_id, photo_id, product_id, confirmed FROM kept UNION ALL SELECT lot_id, photo_id, product_id, false FROM new WHERE photo_id NOT IN (SELECT photo_id FROM kept)
""")
def saved_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos and products after new proposals were saved: confirmed ones stay, the others of those lots are replaced."""
    _, _, photos = _lots(spark, sf_dir)
    current = photos.select("lot_id", "photo_id", F.concat(F.lit("p"), F.col("product_id").cast("string")).alias("product_id"), "confirmed")
    proposal = photos.filter((F.col("lot_id") % 3 != 0) & (F.col("photo_id") % 4 != 0)).select("lot_id", "photo_id", F.concat(F.lit("n"), (F.col("photo_id") % 7).cast("string")).alias("product_id"))
    return grouping.saved_assignment(current, proposal)


@query(GROUPED.replace("FROM events)", "FROM events WHERE event_id % 4 <> 0)") + """
SELECT lot_id, photo_id, lot_id || '/' || group_key AS product_id FROM grp UNION ALL SELECT user_id, event_id, CAST(event_id % 50 AS VARCHAR) FROM events WHERE event_id % 4 = 0
""")
def initial_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo's product before curation: its own, else its proposed group."""
    own = derived.photos(spark, sf_dir).withColumn("product_id", F.when(F.col("photo_id") % 4 == 0, F.col("photo_id") % 50))
    return grouping.initial_proposal(own, GAP_S)


@query(f"""
WITH {PHOTOS}, ed AS (SELECT lot_id, 'g' || photo_id % 10 AS group_id, photo_id FROM photos WHERE readable OR photo_id % 3 = 0)
SELECT * FROM ed UNION ALL SELECT lot_id, 'p:' || photo_id, photo_id FROM photos WHERE NOT readable AND photo_id % 3 <> 0
""")
def complete_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited groups with every unreadable photo that they lack in a group of its own."""
    p = derived.photos(spark, sf_dir)
    edited = p.filter(F.col("readable") | (F.col("photo_id") % 3 == 0)).select("lot_id", F.concat(F.lit("g"), (F.col("photo_id") % 10).cast("string")).alias("group_id"), "photo_id")
    return grouping.complete_proposal(edited, p.select("lot_id", "photo_id", "readable"))


@query(ASSIGNED + """
, pairs AS (SELECT lot_id, photo_id AS left_id, right_id FROM near WHERE right_id IS NOT NULL),
log AS (
  SELECT *, left_id % 13 AS seq, 'close' AS action FROM pairs WHERE left_id % 2 = 0 UNION ALL SELECT *, left_id % 11, 'open' FROM pairs WHERE left_id % 3 = 0 UNION ALL SELECT *, 12, 'close' FROM pairs WHERE left_id % 5 = 0),
last AS (SELECT lot_id, left_id, right_id, max(CASE WHEN action = 'open' THEN seq END) AS opened, max(CASE WHEN action = 'close' THEN seq END) AS closed FROM log GROUP BY ALL)
SELECT lot_id, left_id, right_id FROM last WHERE opened IS NOT NULL AND opened >= coalesce(closed, -1)
UNION SELECT s.lot_id, s.left_id, s.right_id FROM seams s LEFT JOIN last l USING (lot_id, left_id, right_id) WHERE l.lot_id IS NULL
""")
def seam_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open seams after a log of splits and merges, several on one pair: the last one counts."""
    own = _assignment(spark, sf_dir)
    pairs = grouping.open_seams_of(own.withColumn("product_id", F.lit(None)))
    left = F.col("left_id")
    log = pairs.filter(left % 2 == 0).withColumns({"seq": left % 13, "action": F.lit("close")}).unionByName(pairs.filter(left % 3 == 0).withColumns({"seq": left % 11, "action": F.lit("open")}))
    log = log.unionByName(pairs.filter(left % 5 == 0).withColumns({"seq": F.lit(12).cast("long"), "action": F.lit("close")}))
    return grouping.edited_seams(grouping.open_seams_of(own), log)


_SWEEP = SQL["threshold_sweep"].replace("[3600.0, ", "[0.001, 3600.0, ").replace("SELECT CAST(f.threshold_s AS DOUBLE) AS threshold_s", ", sw AS (SELECT CAST(f.threshold_s AS DOUBLE) AS threshold_s").rstrip() + ")"


@query(_SWEEP + ", cl AS (SELECT min(threshold_s) FILTER (fusions > 0) AS cliff FROM sw) SELECT max(threshold_s) AS safe_max, max(cliff) AS cliff, max(cliff) - max(threshold_s) AS margin_s FROM sw, cl WHERE cliff IS NULL OR threshold_s < cliff")
def safe_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to which gap threshold no two products are merged, and where they first are."""
    p = derived.photos(spark, sf_dir).filter("captured_at IS NOT NULL").withColumn("true_id", F.floor(F.col("photo_id") / 5))
    swept = evals.sweep(p, spark.createDataFrame([(x,) for x in (0.001, 3600.0, 21600.0, 43200.0, 86400.0)], "threshold_s double"))
    return evals.safe_zone(swept)


# -- records ---------------------------------------------------------------------------------------------------------

_SAID = """
WITH s AS (SELECT p_partkey AS product_id, unnest([{'f': 'marca', 'v': p_brand, 'c': 'media', 'k': 1}, {'f': 'modelo', 'v': ' ', 'c': 'baja', 'k': 2}, {'f': 'color', 'v': p_name, 'c': CASE WHEN p_size % 2 = 0 THEN 'alta' ELSE 'media' END, 'k': 3}]) AS o FROM part WHERE p_partkey % 5 <> 0)
"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesis answers about every part as JSON; every fifth is corrupt."""
    p = derived.table(spark, sf_dir, "part")
    field = lambda value, confidence, k: F.struct(value.alias("value"), ((F.col("p_partkey") + k) % 2 == 0).alias("visible"), F.lit("  ").alias("cited_text"), confidence.alias("confidence"))
    body = F.to_json(F.struct(field(F.col("p_brand"), F.lit("media"), 1).alias("marca"), field(F.lit(" "), F.lit("baja"), 2).alias("modelo"), field(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "alta").otherwise("media"), 3).alias("color")))
    return p.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 5 != 0, body).otherwise("{broken").alias("body"))


@query(_SAID + "SELECT product_id, o.f AS field, nullif(trim(o.v), '') AS value, (product_id + o.k) % 2 = 0 AS visible, CAST(NULL AS VARCHAR) AS cited_text, o.c AS confidence FROM s WHERE o.c <> 'alta'")
def synthesis_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the answers that a model gave about every part."""
    return ingest.synthesis_rows(_said(spark, sf_dir))[0]


@query(_SAID + "SELECT product_id, o.f AS field, 'invalid_synthesis' AS reason FROM s WHERE o.c = 'alta' UNION ALL SELECT p_partkey, NULL, 'invalid_synthesis' FROM part WHERE p_partkey % 5 = 0")
def synthesis_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are no objects, and fields with a confidence that a model may not claim."""
    return ingest.synthesis_rows(_said(spark, sf_dir))[1]


_KIND = "CASE event_type WHEN 'click' THEN 'extracted' WHEN 'purchase' THEN 'listing_confirmed' WHEN 'signup' THEN 'grouping_confirmed' ELSE event_type END"


def _listing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as events of one listing for each user."""
    e = derived.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "extracted").when(F.col("event_type") == "purchase", "listing_confirmed").when(F.col("event_type") == "signup", "grouping_confirmed").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("product_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("type"), F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit("}")).alias("fields_json"))


@query(f"""
WITH e AS (SELECT user_id AS product_id, event_id, {_KIND} AS type FROM events)
SELECT product_id, '{{"n":' || max(event_id) || '}}' AS fields_json, arg_max(type, event_id) = 'listing_confirmed' AS confirmed FROM e WHERE type IN ('extracted', 'listing_confirmed') GROUP BY product_id
""")
def listing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every listing and whether they are confirmed: a new extraction clears the confirmation."""
    return ledger.field_maps(_listing_events(spark, sf_dir))


@query(f"""
WITH e AS (SELECT user_id AS product_id, ts, {_KIND} AS type FROM events)
SELECT product_id, CASE type WHEN 'grouping_confirmed' THEN 'agrupacion' ELSE 'ficha' END AS kind, min(ts) AS first_at, count(*) AS times FROM e WHERE type IN ('grouping_confirmed', 'listing_confirmed') GROUP BY ALL
""")
def confirmation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each product was first confirmed in either way, and how often."""
    return ledger.confirmations(_listing_events(spark, sf_dir))


@query(LEDGER.replace("THEN p_partkey END AS reference, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS cost", "THEN p_partkey END AS reference, CASE WHEN p_partkey % 5 <> 0 THEN CAST(round_even(p_retailprice * 100, 0) AS BIGINT) ELSE 0 END AS cost") + """
, used AS (SELECT product_id, list_sort(list(DISTINCT platform)) AS u FROM pub GROUP BY product_id)
SELECT product_id, state IS NULL AND coalesce(cost_cents, 0) = 0 AS zero_cost_warning, array_to_string(list_concat(coalesce(u, []), list_filter(['wallapop', 'vinted'], lambda p: NOT list_contains(coalesce(u, []), p))), ',') AS options FROM led LEFT JOIN used USING (product_id)
""")
def ledger_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsold products without a cost, and the platforms that a form offers for each, those in use first."""
    costs = _products(spark, sf_dir).withColumn("cost_cents", F.when(F.col("product_id") % 5 != 0, F.col("cost_cents")).otherwise(0))
    rows = ledger.platform_options(ledger.ledger(costs, _state(spark, sf_dir)))
    return rows.select("product_id", "zero_cost_warning", F.array_join("options", ",").alias("options"))


@query("SELECT doc_id AS photo_id, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS phash, nullif(concat_ws('; ', CASE WHEN doc_id % 7 = 0 THEN 'unreadable' END, CASE WHEN doc_id % 5 = 0 THEN 'no picture' END), '') AS error FROM documents")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fingerprints of every document as a photo's bytes; either fails alone."""
    k = F.col("doc_id")
    rows = derived.table(spark, sf_dir, "documents").select(k.alias("photo_id"), F.encode("text", "UTF-8").alias("content"), F.when(k % 7 == 0, "unreadable").alias("content_error"), k.alias("phash"), F.when(k % 5 == 0, "no picture").alias("phash_error"))
    return ingest.fingerprints(rows)


@query(rf"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^\p{{L}}\p{{Nd}}\s.,;:!¿?¡''"()€%/&\-\n\r\t]'))), ' ') AS signs FROM documents
""")
def unallowed_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of every document that a listing may not hold."""
    return derived.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.disallowed(F.col("text"))), " ").alias("signs"))


@query("SELECT l_orderkey, l_linenumber, 'IMG_' || l_partkey || '_' || l_linenumber * 10 || '_' || l_suppkey % 90 || '_' || CAST(l_quantity AS BIGINT) || '_40.jpg' AS crop FROM lineitem")
def crop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file name of a crop for every line item as a region."""
    name = F.concat(F.lit("IMG_"), F.col("l_partkey").cast("string"), F.lit(".png"))
    return derived.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", usage.crop_name(name, (F.col("l_linenumber") * 10).cast("long"), F.col("l_suppkey") % 90, F.col("l_quantity").cast("long"), F.lit(40)).alias("crop"))


_EANS = SQL["ean_checks"].split("SELECT o_orderkey AS product_id")[0]


@query(_EANS + "SELECT o_orderkey AS product_id, CASE WHEN o_orderkey % 3 = 0 THEN 'text ' || digits ELSE digits END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'talla' ELSE 'ean' END AS content FROM s WHERE o_orderkey % 3 = 0 OR (10 - total % 10) % 10 = CAST(digits[length(digits)] AS INTEGER)")
def checked_ean_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without EANs of a wrong check digit; kept ones are digits only, other content stays."""
    k = F.col("product_id")
    spaced = F.concat(F.substring("digits", 1, 4), F.lit(" "), F.expr("substring(digits, 5)"))
    rows = ean_checks(spark, sf_dir).select("product_id", F.when(k % 3 == 0, "talla").otherwise("ean").alias("content"), F.when(k % 3 == 0, F.concat(F.lit("text "), "digits")).otherwise(spaced).alias("text"), F.lit(True).alias("legible"))
    return readings.checked_eans(rows).select("product_id", "text", "content")


@query(_EANS + "SELECT o_orderkey AS product_id, CASE WHEN (10 - total % 10) % 10 = CAST(digits[length(digits)] AS INTEGER) THEN digits END AS value, CASE WHEN (10 - total % 10) % 10 = CAST(digits[length(digits)] AS INTEGER) THEN 'alta' ELSE 'baja' END AS confidence FROM s")
def checked_ean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EAN fields that a check digit confirms or clears."""
    rows = ean_checks(spark, sf_dir).select("product_id", F.lit("ean").alias("field"), F.col("digits").alias("value"), F.lit("alta").alias("confidence"))
    return readings.checked_ean_field(rows).select("product_id", "value", "confidence")


_WIDE_FIELDS = "w AS (SELECT product_id, " + ", ".join(f"max(nullif(trim(value), '')) FILTER (field = '{f}') AS {f}" for f in ("titulo", "descripcion", "categoria", "estado", "marca", "talla", "color", "desperfectos")) + " FROM fields GROUP BY product_id)"


@query(FIELDS + f""", {_WIDE_FIELDS}
SELECT product_id, array_to_string(list_filter([CASE WHEN categoria IS NULL THEN 'categoria' END, CASE WHEN estado IS NULL THEN 'estado' END, CASE WHEN titulo IS NULL THEN 'titulo' END, CASE WHEN descripcion IS NULL THEN 'descripcion' END], lambda x: x IS NOT NULL), ',') AS missing,
  categoria IS NOT NULL AND estado IS NOT NULL AND titulo IS NOT NULL AND descripcion IS NOT NULL AS ready FROM w
""")
def ready_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that can be confirmed, and what the others lack."""
    ready, skipped = listings.ready_and_skipped(listings.pivoted(_fields(spark, sf_dir)))
    shown = lambda rows, ok: rows.select("product_id", F.array_join("missing", ",").alias("missing"), F.lit(ok).alias("ready"))
    return shown(ready, True).unionByName(shown(skipped, False))


_EDITED = "ed AS (SELECT p_partkey AS product_id, 'titulo' AS field FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'descripcion' FROM part WHERE p_partkey % 3 = 0)"


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.filter(k % 2 == 0).select(k.alias("product_id"), F.lit("titulo").alias("field")).union(p.filter(k % 3 == 0).select(k, F.lit("descripcion")))


@query(FIELDS + f""", {_WIDE_FIELDS}, {_EDITED}
SELECT product_id, concat_ws(chr(10), 'marca: ' || marca, 'talla: ' || talla, 'color: ' || color, 'estado: ' || estado, 'desperfectos: ' || desperfectos) AS prompt FROM w WHERE product_id % 6 <> 0
""")
def redaction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is told about every listing whose title or description nobody edited."""
    return listings.redaction_requests(listings.pivoted(_fields(spark, sf_dir)), _edited(spark, sf_dir))


@query(FIELDS + f""", {_WIDE_FIELDS}, t AS (SELECT *, product_id % 2 = 0 AS kt, product_id % 3 = 0 AS kd, CASE WHEN product_id % 10 <> 1 THEN 'Nuevo titulo ' || product_id END AS nt, CASE WHEN product_id % 10 <> 5 THEN 'Texto nuevo' END AS nd FROM w)
SELECT product_id, CASE WHEN kt THEN titulo ELSE nt END AS titulo, CASE WHEN kd THEN descripcion WHEN desperfectos IS NOT NULL THEN nd || chr(10) || chr(10) || 'DESPERFECTOS: ' || desperfectos ELSE nd END AS descripcion FROM t WHERE (kt OR nt IS NOT NULL) AND (kd OR nd IS NOT NULL)
""")
def redacted_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a model's texts where nobody edited them; those that lack a text are rejected."""
    k = F.col("p_partkey")
    texts = derived.table(spark, sf_dir, "part").select(k.alias("product_id"), F.when(k % 10 != 1, F.concat(F.lit("Nuevo titulo "), k.cast("string"))).alias("new_title"), F.when(k % 10 != 5, F.lit("Texto nuevo")).alias("new_description"))
    done, _ = listings.apply_redaction(listings.pivoted(_fields(spark, sf_dir)), texts, _edited(spark, sf_dir))
    return done.select("product_id", "titulo", "descripcion")


# -- payloads --------------------------------------------------------------------------------------------------------

_LIMIT = "CASE WHEN platform = 'vinted' THEN 20 ELSE 10 END"
_UNCOVERED = " ".join(f"WHEN '{p}' THEN [{', '.join(repr('required:' + f) for q, f, need, _, _ in dims.FIELDS if q == p and need and f not in dims.COVERED[p])}]" for p in dims.PLATFORMS)
PAYLOADS = FIELDS + f""", {_WIDE_FIELDS}, un AS (SELECT product_id, list_sort(list(DISTINCT field) FILTER (source = 'inferido')) AS unreviewed FROM fields GROUP BY product_id),
cond AS (SELECT *, min(level) OVER (PARTITION BY platform, category, literal) AS communicated FROM (VALUES {_COND}) t(level, code, platform, category, literal)),
b AS (SELECT w.*, p.platform, unreviewed, literal, CASE WHEN cond.level - communicated >= 2 THEN 'overstated' WHEN cond.level = 6 AND communicated < 6 THEN 'broken_as_working' END AS fidelity,
    coalesce(titulo, '') AS title, descripcion || CASE WHEN w.product_id % 2 = 0 THEN chr(10) || chr(10) || 'Ref. ' || w.product_id ELSE '' END AS description, lower(coalesce(titulo, '') || ' ' || descripcion) AS t, range(1, w.product_id % 25 + 2) AS ph
  FROM w JOIN un USING (product_id) CROSS JOIN (VALUES ('vinted'), ('wallapop')) p(platform) LEFT JOIN (VALUES {_CHOICE}) ch(choice, level) ON ch.choice = w.estado LEFT JOIN cond ON cond.platform = p.platform AND cond.category = w.categoria AND cond.level = ch.level),
gated AS (SELECT *, list_filter([CASE WHEN product_id % 8 = 0 THEN 'not_confirmed' END, CASE WHEN title = '' THEN 'title:TOO_SHORT' END], lambda x: x IS NOT NULL) AS reasons,
    list_filter(ph, lambda i: (product_id * 100 + i) % 97 <> 0) AS known, CASE WHEN {_heavy} THEN 'pesado' WHEN {_light} THEN 'ligero' ELSE 'normal' END AS shipping FROM b)
"""


def in_full(done: DataFrame) -> DataFrame:
    """Payloads as flat rows: one text for the fields, the warnings and either list of photos."""
    line = lambda f: F.concat_ws("|", f["name"], f["label"], F.coalesce(f["value"], F.lit("")), f["translated"].cast("string"), F.coalesce(f["note"], F.lit("")))
    return done.select("product_id", "platform", "title", "description", F.array_join(F.transform("fields", line), ";").alias("fields"), *(F.array_join(c, ",").alias(c) for c in ("warnings", "included", "excluded")))


@query(PAYLOADS + f"""
SELECT product_id, platform, title, description, concat_ws(';',
  concat_ws('|', 'marca', CASE WHEN platform = 'vinted' THEN 'brand' ELSE 'marca' END, CASE WHEN platform = 'vinted' THEN coalesce(marca, 'Sin marca') ELSE coalesce(marca, '') END, CAST(platform = 'vinted' OR marca IS NOT NULL AS VARCHAR), CASE WHEN platform = 'vinted' AND marca IS NULL THEN 'no brand read or confirmed' ELSE '' END),
  concat_ws('|', 'talla', CASE WHEN platform = 'vinted' THEN 'size_id' ELSE 'size' END, coalesce(talla, ''), 'false', CASE WHEN platform = 'vinted' THEN 'pick the size by hand' ELSE 'compose the size by hand' END),
  concat_ws('|', 'estado', CASE WHEN platform = 'vinted' THEN 'status_id' ELSE 'estado' END, coalesce(literal, ''), CAST(literal IS NOT NULL AND fidelity IS NULL AS VARCHAR), coalesce(fidelity, '')),
  concat_ws('|', 'envio', CASE WHEN platform = 'vinted' THEN 'package_size' ELSE 'tramo_peso_kg' END, CASE WHEN platform = 'vinted' THEN CASE shipping WHEN 'ligero' THEN 'Pequeño' WHEN 'normal' THEN 'Mediano' ELSE 'Grande' END ELSE CASE shipping WHEN 'ligero' THEN '2 kg' WHEN 'normal' THEN '5 kg' ELSE '10 kg' END END, 'false', 'suggested, rather too large'),
  CASE WHEN color IS NOT NULL THEN 'color|color|' || color || '|false|pick from the platform''s list' END, CASE WHEN desperfectos IS NOT NULL THEN 'desperfectos|desperfectos|' || desperfectos || '|false|must stand in the description' END) AS fields,
  array_to_string(list_concat(list_filter([CASE WHEN product_id % 9 = 0 THEN 'coherence' END, CASE WHEN len(unreviewed) > 0 THEN 'unreviewed:' || len(unreviewed) || ':' || array_to_string(unreviewed, ',') END, CASE WHEN platform = 'wallapop' AND marca IS NULL THEN 'no_brand' END, CASE WHEN talla IS NULL THEN 'no_size' END, CASE WHEN literal IS NULL THEN 'no_condition' END,
    'condition:' || fidelity, CASE WHEN desperfectos IS NOT NULL THEN 'check_defect' END], lambda x: x IS NOT NULL), CASE platform {_UNCOVERED} END, list_filter([CASE WHEN len(list_filter(known, lambda i: i <= {_LIMIT})) = 0 THEN 'no_photos' END, CASE WHEN len(list_filter(known, lambda i: i > {_LIMIT})) > 0 THEN 'over_photo_limit:' || len(list_filter(known, lambda i: i > {_LIMIT})) END,
    CASE WHEN len(known) < len(ph) THEN 'unknown_photos' END, 'no_category_tree'], lambda x: x IS NOT NULL)), ',') AS warnings,
  array_to_string(list_transform(list_filter(known, lambda i: i <= {_LIMIT}), lambda i: '/p/' || (product_id * 100 + i)), ',') AS included, array_to_string(list_transform(list_filter(known, lambda i: i > {_LIMIT}), lambda i: '/p/' || (product_id * 100 + i)), ',') AS excluded FROM gated WHERE len(reasons) = 0
""")
def whole_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payload in full: texts, fields, warnings and photos."""
    return in_full(_payloads(spark, sf_dir)[0])


SQL["blocked_payloads"] = PAYLOADS + "SELECT product_id, platform, array_to_string(reasons, ',') AS reasons FROM gated WHERE len(reasons) > 0"
_BLOCKS = ", ".join(f"('{p}', '{b}', {n})" for p, names in dims.BLOCK_ORDER.items() for n, b in enumerate(names))
SQL["payload_blocks"] = PAYLOADS + f"""
, nm AS (SELECT product_id, platform, unnest(['resumen', 'fotos', 'categoria', 'titulo_desc', 'precio', 'marca', 'talla', 'estado', CASE WHEN platform = 'vinted' THEN 'package_size' ELSE 'tramo_peso_kg' END, CASE WHEN color IS NOT NULL THEN 'color' END, CASE WHEN desperfectos IS NOT NULL THEN 'desperfectos' END]) AS block FROM gated WHERE len(reasons) = 0)
SELECT product_id, platform, pos, block FROM nm JOIN (VALUES {_BLOCKS}) o(platform, block, pos) USING (platform, block)
"""
SQL["suggested_terms"] = "WITH attr AS (SELECT p_partkey AS product_id, p_brand AS marca, p_name AS modelo, p_type AS tipo, CAST(p_size AS VARCHAR) AS talla FROM part)" + VARIANTS + "SELECT product_id, pos, terms FROM vars"
SQL["gap_filled_fields"] = READINGS + """
, ct AS (SELECT product_id, lower(trim(text)) AS k, arg_min(location, seq) AS loc, arg_min(photo, seq) AS ph FROM rd WHERE legible AND trim(text) <> '' GROUP BY ALL),
sd AS (SELECT product_id, f.field, arg_min(text, seq) AS said FROM rd, (VALUES ('marca'), ('modelo')) f(field) GROUP BY ALL),
j AS (SELECT res.*, trim(said) AS said, value IS NULL AND trim(said) <> '' AS fill, CASE WHEN res.field = 'marca' THEN loc = 'etiqueta_interior' ELSE loc IN ('etiqueta_interior', 'codigo_o_modelo_impreso') END AS seen, ph FROM res LEFT JOIN sd USING (product_id, field) LEFT JOIN ct ON ct.product_id = res.product_id AND ct.k = lower(trim(said)))
SELECT product_id, field, CASE WHEN fill THEN said ELSE value END AS value, CASE WHEN NOT coalesce(fill, false) THEN source WHEN seen THEN 'foto' ELSE 'inferido' END AS source, CASE WHEN NOT coalesce(fill, false) THEN confidence WHEN seen THEN 'media' ELSE 'baja' END AS confidence,
  CASE WHEN NOT coalesce(fill, false) THEN photo WHEN seen THEN ph END AS photo, CASE WHEN NOT coalesce(fill, false) THEN reason WHEN seen THEN 'synthesis_seen' ELSE 'synthesis_inferred' END AS reason FROM j
"""


# -- regions ---------------------------------------------------------------------------------------------------------

REGIONS = """
WITH RECURSIVE rg AS (SELECT conv_id AS product_id, 'f' || turn // 3 AS photo, turn // 3 AS photo_seq, CAST(turn AS INTEGER) AS region_seq, CAST(turn * 30 % 700 AS INTEGER) AS x, CAST(turn * 130 % 900 AS INTEGER) AS y, 200 AS w, 40 AS h FROM conversations),
near AS (SELECT a.product_id, a.photo, a.region_seq AS a, b.region_seq AS b FROM rg a JOIN rg b ON a.product_id = b.product_id AND a.photo = b.photo AND a.region_seq <> b.region_seq AND greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= 150 AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > -400),
reach AS (SELECT product_id, photo, region_seq AS a, region_seq AS b FROM rg UNION SELECT r.product_id, r.photo, r.a, n.b FROM reach r JOIN near n ON n.product_id = r.product_id AND n.photo = r.photo AND n.a = r.b)
"""


@query(REGIONS + "SELECT product_id, photo, a AS region_seq, min(b) AS cluster FROM reach GROUP BY ALL")
def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every region of a photo that nearness connects."""
    return readings.region_clusters(_regions(spark, sf_dir)).select("product_id", "photo", "region_seq", "cluster")


@query(REGIONS + "SELECT product_id, photo, a, b FROM near WHERE a < b")
def near_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of regions of one photo that lie near each other."""
    return readings.near_regions(_regions(spark, sf_dir))


@query(REGIONS + """
, cl AS (SELECT product_id, photo, a AS region_seq, min(b) AS cluster FROM reach GROUP BY ALL)
SELECT product_id, photo, CAST(cluster AS INTEGER) AS cluster, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM cl JOIN rg USING (product_id, photo, region_seq) GROUP BY product_id, photo, cluster
""")
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region for each cluster, with the box around it."""
    own = readings.region_clusters(_regions(spark, sf_dir))
    counts = own.groupBy("product_id", "photo", F.col("cluster").alias("region_seq")).agg(F.count(F.lit(1)).alias("n"))
    return readings.merged_regions(own).join(counts, ["product_id", "photo", "region_seq"]).select("product_id", "photo", F.col("region_seq").alias("cluster"), "x", "y", "w", "h", "n")


_MODEL = r"regexp_extract(text, '(?i)\bmodel\w*\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9\-]{2,20})\b', 1)"
PLANNED = rf"""
WITH rt AS (SELECT conv_id AS product_id, 'f' || turn // 3 AS photo, turn // 3 AS photo_seq, CAST(turn AS INTEGER) AS region_seq, CASE WHEN turn % 5 = 4 THEN 'Model: AB' || conv_id % 50 || ' ' || text ELSE text END AS text FROM conversations),
rk AS (SELECT *, {_MODEL} AS m, length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) AS digits FROM rt),
rp AS (SELECT *, CASE WHEN digits >= 16 AND digits > 0.9 * length(text) THEN 'ruler' WHEN m <> '' THEN 'shortcut' WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 6 OR length(text) > 40 THEN 'long' ELSE 'read' END AS plan0 FROM rk),
kn AS (SELECT product_id, m AS value, min(photo_seq) AS from_seq FROM rp WHERE plan0 = 'shortcut' GROUP BY ALL),
pl AS (SELECT *, CASE WHEN plan0 = 'read' AND EXISTS (SELECT 1 FROM kn WHERE kn.product_id = rp.product_id AND contains(rp.text, kn.value) AND from_seq <= rp.photo_seq) THEN 'repeat' ELSE plan0 END AS plan FROM rp)
"""
SQL["region_plan"] = PLANNED + "SELECT product_id, photo, region_seq, plan, CASE WHEN plan = 'shortcut' THEN m END AS value FROM pl"


@query(PLANNED + READINGS.replace("WITH rd AS (", ", rd0 AS (", 1).replace("),\npb AS (", """),
last AS (SELECT product_id, max(seq) AS s FROM rd0 GROUP BY product_id),
rd AS (SELECT product_id, seq, photo, legible, location, field, text FROM rd0 UNION ALL SELECT pl.product_id, coalesce(s, 0) + row_number() OVER (PARTITION BY pl.product_id ORDER BY photo_seq, region_seq), photo, true, 'codigo_o_modelo_impreso', 'modelo', m FROM pl LEFT JOIN last ON last.product_id = pl.product_id WHERE plan = 'shortcut'),
pb AS (""", 1) + "SELECT product_id, field, value, source, confidence, photo, reason FROM res")
def pooled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields resolved from a model's readings and from what OCR alone gives."""
    pool = readings.pooled_readings(derived.readings(spark, sf_dir), readings.plan_regions(_regions(spark, sf_dir)))
    return readings.resolve(pool).select("product_id", "field", "value", "source", "confidence", "photo", "reason")
