"""Queries over listings: text rules, conditions, readings, categories, review, payloads, stored records, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.functions import text as T
from listingops.operators import evals, listings, pricing, readings, taxonomy, usage
from listingops.plans.registry import query
from listingops.sources import derived, dims, ingest

_list = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
PLAIN = f"translate({{0}}, '{dims.LATIN_FROM}', '{dims.LATIN_TO}')"
STEM = "CASE WHEN length({0}) > 4 AND {0} LIKE '%es' THEN left({0}, length({0}) - 2) WHEN length({0}) > 3 AND {0} LIKE '%s' THEN left({0}, length({0}) - 1) ELSE {0} END"
STRIP = r"""regexp_replace(regexp_replace(w, '^[.,;:!¿?¡''"()]+', ''), '[.,;:!¿?¡''"()]+$', '')"""
_brands = ", ".join("CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])" + b.replace("'", "''") + "($|[^\\p{L}\\p{N}_])') AND lower(trim(coalesce(brand, ''))) <> '" + b.replace("'", "''") + "' THEN 1 END" for b in dims.BRANDS)


@query(rf"""
WITH t AS (SELECT doc_id AS text_id, CASE WHEN doc_id % 2 = 0 THEN 'vinted' ELSE 'wallapop' END AS platform, CASE WHEN doc_id % 3 = 0 THEN 'Nike' END AS brand, text FROM documents),
c AS (SELECT *, length(text) AS n, CASE WHEN platform = 'vinted' THEN 5 ELSE 1 END AS least, CASE WHEN platform = 'vinted' THEN 2000 ELSE 600 END AS most,
  length(regexp_replace(text, '[\p{{L}}\p{{Nd}}\s]', '', 'g')) AS odd, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS upper_, regexp_extract_all(text, '[^\p{{L}}\p{{N}}_\s]{{4,}}') AS runs FROM t)
SELECT text_id, platform, n, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') THEN 'CONTAINS_EMAIL' END,
  CASE WHEN regexp_matches(text, '(?i)(https?://|www\.)\S+') THEN 'CONTAINS_LINK' END,
  CASE WHEN (n >= 20 AND odd > 0.15 * n) OR len(list_filter(runs, lambda r: len(list_filter(range(1, length(r) - 2), lambda i: r[i] = r[i + 1] AND r[i] = r[i + 2] AND r[i] = r[i + 3])) > 0)) > 0 THEN 'EXCESSIVE_SYMBOLS' END,
  CASE WHEN letters >= 10 AND upper_ > 0.5 * letters THEN 'EXCESSIVE_UPPERCASE' END,
  CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length({STRIP}) > 30)) > 0 THEN 'LONG_WORDS' END,
  CASE WHEN coalesce({_brands}) IS NOT NULL THEN 'MENTIONS_OTHER_BRAND' END,
  CASE WHEN n > most THEN 'TOO_LONG' END, CASE WHEN n < least THEN 'TOO_SHORT' END,
  CASE WHEN regexp_matches(text, '[^\p{{L}}\p{{Nd}}\s.,;:!¿?¡''"()€%/&\-]') THEN 'UNALLOWED_SYMBOLS' END], lambda x: x IS NOT NULL), ',') AS codes FROM c
""")
def text_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content rules that every document breaks as a description."""
    out = listings.text_violations(derived.texts(spark, sf_dir))
    return out.select("text_id", "platform", "n", F.array_join("codes", ",").alias("codes"))


@query(rf"""
WITH w AS (SELECT unnest(regexp_extract_all({PLAIN.format('lower(text)')}, '[a-z0-9]+')) AS token FROM documents), k AS (SELECT token FROM w WHERE length(token) >= 3 AND token NOT IN ({_list(dims.RANKING_STOP_WORDS)}))
SELECT {STEM.format('token')} AS stem, count(*) AS n, count(DISTINCT token) AS forms FROM k GROUP BY 1
""")
def token_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking tokens of every document by stem."""
    rows = derived.table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return rows.groupBy(T.stem(F.col("token")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("forms"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(regexp_replace(line, '[^\p{{Nd}}]', '', 'g')) >= 16 AND length(regexp_replace(line, '[^\p{{Nd}}]', '', 'g')) > 0.9 * length(line)) AS ruler,
  count(*) FILTER (len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) > 6 OR length(line) > 40) AS long_blocks,
  count(*) FILTER (length(regexp_replace(line, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 3) AS witnesses FROM l GROUP BY doc_id
""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that look like ruler tape, long blocks or usable witnesses."""
    rows = derived.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.is_ruler_text(F.col("line"))).alias("ruler"), F.count_if(T.is_long_block(F.col("line"))).alias("long_blocks"), F.count_if(T.is_witness(F.col("line"))).alias("witnesses"))


_heavy = " OR ".join(f"contains(t, '{w}')" for w in dims.HEAVY_WORDS)
_light = " OR ".join(f"contains(t, '{w}')" for w in dims.LIGHT_WORDS)
_garment = " ".join(f"WHEN contains({PLAIN.format('t')}, '{g}') THEN '{g}'" for g in dims.GARMENTS)


@query(rf"""
WITH d AS (SELECT doc_id, text, lower(text || ' ' || CASE doc_id % 5 WHEN 0 THEN 'Camisa con botas' WHEN 1 THEN 'PANTALÓN y gorra' ELSE '' END) AS t FROM documents)
SELECT doc_id, CASE WHEN {_heavy} THEN 'pesado' WHEN {_light} THEN 'ligero' ELSE 'normal' END AS shipping, CASE {_garment} END AS garment,
  CASE WHEN doc_id % 4 = 0 THEN text WHEN trim(text) = '' THEN 'Ref. ' || doc_id WHEN rtrim(text) LIKE '%Ref. ' || doc_id THEN rtrim(text) ELSE rtrim(text) || chr(10) || chr(10) || 'Ref. ' || doc_id END AS stamped,
  CASE WHEN left(text, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || text ELSE text END AS guarded FROM d
""")
def listing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping class, garment, stamped reference and formula guard of every document."""
    d = derived.table(spark, sf_dir, "documents")
    extra = F.when(F.col("doc_id") % 5 == 0, "Camisa con botas").when(F.col("doc_id") % 5 == 1, "PANTALÓN y gorra").otherwise("")
    t = F.concat("text", F.lit(" "), extra)
    return d.select("doc_id", T.shipping_class(t).alias("shipping"), T.garment(t).alias("garment"), T.stamped(F.col("text"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id"))).alias("stamped"), T.guarded(F.col("text")).alias("guarded"))


_COND = ", ".join(f"({n}, '{c}', '{p}', '{k}', '{dims.literal(n, p, k)}')" for n, c in enumerate(dims.CONDITIONS) for p in dims.PLATFORMS for k in dims.CATEGORIES)
_CHOICE = ", ".join(f"('{c}', {n})" for c, n in dims.CHOICES.items())


@query(f"""
WITH cond AS (SELECT *, min(level) OVER (PARTITION BY platform, category, literal) AS communicated FROM (VALUES {_COND}) t(level, code, platform, category, literal)),
c AS (SELECT p_partkey AS product_id, list_extract([{_list(dims.CATEGORIES)}], CAST(p_size % 5 + 1 AS INTEGER)) AS category, list_extract([{_list([*dims.CHOICES, '(sin elegir)'])}], CAST(p_partkey % 7 + 1 AS INTEGER)) AS choice FROM part)
SELECT c.product_id, p.platform, ch.level, literal, CASE WHEN cond.level - communicated >= 2 THEN 'overstated' WHEN cond.level = 6 AND communicated < 6 THEN 'broken_as_working' END AS note
FROM c CROSS JOIN (VALUES ('vinted'), ('wallapop')) p(platform) LEFT JOIN (VALUES {_CHOICE}) ch(choice, level) ON ch.choice = c.choice LEFT JOIN cond ON cond.platform = p.platform AND cond.category = c.category AND cond.level = ch.level
""")
def condition_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition text of every product on either platform, with fidelity notes."""
    p = derived.table(spark, sf_dir, "part")
    pick = lambda xs, i: F.get(F.array(*(F.lit(x) for x in xs)), i.cast("int"))
    rows = p.select(F.col("p_partkey").alias("product_id"), pick(dims.CATEGORIES, F.col("p_size") % 5).alias("category"), pick([*dims.CHOICES, "(sin elegir)"], F.col("p_partkey") % 7).alias("choice"))
    return listings.mapped_conditions(rows).select("product_id", "platform", "level", "literal", "note")


READINGS = """
WITH rd AS (SELECT conv_id AS product_id, CAST(turn AS BIGINT) AS seq, 'f' || (turn % 2) || '.jpg' AS photo, length(text) % 5 <> 0 AS legible, list_extract(['etiqueta_interior', 'estampado_o_grafico', 'codigo_o_modelo_impreso'], CAST(length(text) % 3 + 1 AS INTEGER)) AS location,
  list_extract(['marca', 'talla', 'modelo'], CAST(turn % 3 + 1 AS INTEGER)) AS field, text FROM conversations),
pb AS (SELECT *, (field IN ('marca', 'talla') AND location = 'etiqueta_interior') OR (field = 'modelo' AND location <> 'estampado_o_grafico') AS ok, legible AND trim(text) <> '' AS seen FROM rd),
ag AS (SELECT product_id, field, count(DISTINCT CASE WHEN seen THEN lower(trim(text)) END) AS n, arg_min(text, seq) FILTER (seen AND ok) AS best, arg_min(photo, seq) FILTER (seen AND ok) AS best_photo, arg_min(photo, seq) FILTER (ok) AS tried FROM pb GROUP BY ALL),
f AS (SELECT p.product_id, k.field, coalesce(n, 0) AS n, best, best_photo, tried FROM (SELECT DISTINCT product_id FROM rd) p CROSS JOIN (VALUES ('marca'), ('talla'), ('modelo'), ('ean')) k(field) LEFT JOIN ag USING (product_id, field)),
res AS (SELECT product_id, field, CASE WHEN n = 1 THEN best END AS value, CASE WHEN (n = 1 AND best IS NOT NULL) OR (n <= 1 AND tried IS NOT NULL) THEN 'foto' ELSE 'inferido' END AS source, CASE WHEN n = 1 AND best IS NOT NULL THEN 'media' ELSE 'baja' END AS confidence,
  CASE WHEN n = 1 AND best IS NOT NULL THEN best_photo WHEN n <= 1 THEN tried END AS photo,
  CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 AND best IS NOT NULL THEN 'single_value' WHEN n = 1 THEN 'only_elsewhere' WHEN tried IS NOT NULL THEN 'illegible' ELSE 'not_photographed' END AS reason FROM f)
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.resolve(derived.readings(spark, sf_dir))


@query(READINGS + "SELECT product_id, field, value, source, confidence, photo, reason FROM res")
def resolved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each product and field, from all its readings."""
    return _resolved(spark, sf_dir).select("product_id", "field", "value", "source", "confidence", "photo", "reason")


@query(READINGS + "SELECT product_id, count(*) >= 2 AND count(DISTINCT photo) > 1 AS disjoint, string_agg(DISTINCT photo, ',' ORDER BY photo) AS files FROM res WHERE value IS NOT NULL AND photo IS NOT NULL GROUP BY product_id")
def field_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a product's identity fields come from files that have nothing in common."""
    return readings.coherence(_resolved(spark, sf_dir)).select("product_id", "disjoint", F.array_join("files", ",").alias("files"))


@query(READINGS + "SELECT product_id, string_agg(line, chr(10) ORDER BY s) AS lines FROM (SELECT product_id, location || ' | ' || field || ' | ' || trim(text) AS line, min(seq) AS s FROM pb WHERE seen GROUP BY ALL) GROUP BY product_id")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legible readings of every product as prompt lines, each once."""
    return readings.candidate_lines(derived.readings(spark, sf_dir))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose first word is written after a marker with as many OCR errors as the turn says."""
    r = derived.readings(spark, sf_dir)
    heads = F.array(*(F.lit(h) for h in ("DESPERFECTOS:", "DESPERFECT0S:", "acabados PERFECTOS", "DESPERFECT05-", "DESPERFECTOS :")))
    return r.withColumn("text", F.concat_ws(" ", F.get(heads, (F.col("seq") % 5).cast("int")), "text"))


@query(READINGS + """
, no AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq) AS k FROM pb WHERE legible AND seq % 5 IN (0, 1, 3) AND trim(text) <> '')
SELECT product_id, max(trim(text)) FILTER (k = 1) AS value, count(*) - 1 AS others FROM no GROUP BY product_id
""")
def marker_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first note behind the defect marker of every product."""
    return readings.marker_notes(_notes(spark, sf_dir)).select("product_id", "value", F.size("alternatives").cast("long").alias("others"))


@query(rf"""
WITH lf AS (SELECT p_type AS t, p_brand AS b, p_name AS name, min(p_partkey) AS leaf_id FROM part GROUP BY ALL),
tok AS (SELECT DISTINCT leaf_id, token FROM (SELECT leaf_id, unnest(regexp_extract_all(lower(t || ' ' || b || ' ' || name), '[a-z0-9]+')) AS token FROM lf) WHERE length(token) >= 3 AND token NOT IN ({_list(dims.RANKING_STOP_WORDS)})),
st AS (SELECT DISTINCT leaf_id, {STEM.format('token')} AS stem FROM tok)
SELECT p.platform, stem, round(ln(1 + (SELECT count(*) FROM lf) / count(*)::DOUBLE), 6) AS idf FROM st, (VALUES ('vinted'), ('wallapop')) p(platform) GROUP BY ALL
""")
def category_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF of the stems of every category path."""
    return taxonomy.idf(derived.leaves(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(rf"""
WITH lf AS (SELECT p_type AS t, p_name AS name, min(p_partkey) AS leaf_id FROM part GROUP BY ALL),
raw AS (SELECT leaf_id, 3.0 AS w, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS token FROM lf UNION ALL SELECT leaf_id, 1.5, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) FROM lf),
tok AS (SELECT DISTINCT leaf_id, w, token FROM raw WHERE length(token) >= 3 AND token NOT IN ({_list(dims.RANKING_STOP_WORDS)})),
ev AS (SELECT DISTINCT leaf_id, {STEM.format('token')} AS stem FROM (SELECT leaf_id, unnest(regexp_extract_all(lower('parts ' || t || ' ' || name), '[a-z0-9]+')) AS token FROM lf) WHERE length(token) >= 3 AND token NOT IN ({_list(dims.RANKING_STOP_WORDS)})),
idf AS (SELECT stem, ln(1 + (SELECT count(*) FROM lf) / count(*)::DOUBLE) AS idf FROM ev GROUP BY stem),
sc AS (SELECT leaf_id, token, max(w * idf) AS w FROM (SELECT leaf_id, token, w, {STEM.format('token')} AS stem FROM tok) JOIN idf USING (stem) GROUP BY ALL),
q AS (SELECT p_partkey AS product_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS qt FROM part),
qq AS (SELECT product_id, qt, row_number() OVER () AS pos FROM q WHERE length(qt) >= 3 AND qt NOT IN ({_list(dims.RANKING_STOP_WORDS)})),
m AS (SELECT product_id, pos, leaf_id, max(sc.w) AS w FROM qq JOIN sc ON ({STEM.format('qt')}) = ({STEM.format('sc.token')}) OR (length(qt) >= 4 AND length(sc.token) >= 4 AND (contains(qt, sc.token) OR contains(sc.token, qt))) GROUP BY ALL),
s AS (SELECT product_id, leaf_id, sum(w) AS score FROM m GROUP BY ALL),
r AS (SELECT product_id, round(score, 5) AS score, row_number() OVER (PARTITION BY product_id ORDER BY score DESC) AS k FROM s)
SELECT product_id, platform, CAST(k AS INTEGER) AS rank, score FROM r, (VALUES ('vinted'), ('wallapop')) p(platform) WHERE k <= 3
""")
def category_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three category leaves for a text about each part."""
    own = derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.lit("otros").alias("category"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return taxonomy.rank_categories(own, derived.type_leaves(spark, sf_dir)).select("product_id", "platform", "rank", F.round("score", 5).alias("score"))


_roots = lambda p: "[" + ", ".join(map(str, derived.TREE_ROOTS[p])) + "]"
_in_scope = " OR ".join(f"(platform = '{p}' AND category = '{c}' AND root_id IN ({', '.join(map(str, ids))}))" for (p, c), ids in dims.ROOTS.items())
_child_root = " OR ".join(f"(platform = '{p}' AND root_id IN ({', '.join(map(str, ids))}))" for p, ids in dims.CHILD_ROOTS.items())
_stems = lambda ws: f"list_has_any(stems, [{_list(T.stems_of(ws))}])"
AUDIENCE_WORDS = ("para mujer", "de chico", "camiseta niña", "6 meses", "hombre y mujer", "")


@query(rf"""
WITH lf AS (SELECT p_type AS t, p_name AS name, min(p_partkey) AS leaf_id, list_extract([{_list(derived.AUDIENCES)}], CAST(length(p_type) % {len(derived.AUDIENCES)} + 1 AS INTEGER)) AS audience FROM part GROUP BY ALL),
raw AS (SELECT leaf_id, 3.0 AS w, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS token FROM lf UNION ALL SELECT leaf_id, 1.5, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) FROM lf UNION ALL SELECT leaf_id, 0.5, unnest(regexp_extract_all(lower(audience), '[a-z0-9]+')) FROM lf),
tok AS (SELECT DISTINCT leaf_id, w, token FROM raw WHERE length(token) >= 3 AND token NOT IN ({_list(dims.RANKING_STOP_WORDS)})),
ev AS (SELECT DISTINCT leaf_id, {STEM.format('token')} AS stem FROM (SELECT leaf_id, unnest(regexp_extract_all(lower('catalogo ' || audience || ' ' || t || ' ' || name), '[a-z0-9]+')) AS token FROM lf) WHERE length(token) >= 3 AND token NOT IN ({_list(dims.RANKING_STOP_WORDS)})),
idf AS (SELECT stem, ln(1 + (SELECT count(*) FROM lf) / count(*)::DOUBLE) AS idf FROM ev GROUP BY stem),
sc AS (SELECT leaf_id, token, max(w * idf) AS w FROM (SELECT leaf_id, token, w, {STEM.format('token')} AS stem FROM tok) JOIN idf USING (stem) GROUP BY ALL),
pr AS (SELECT p_partkey AS product_id, list_extract([{_list(dims.CATEGORIES)}], CAST(p_size % 5 + 1 AS INTEGER)) AS category, {PLAIN.format("lower(p_name || ' ' || p_type || ' ' || list_extract([" + _list(AUDIENCE_WORDS) + "], CAST(p_partkey % 6 + 1 AS INTEGER)))")} AS text FROM part),
qr AS (SELECT *, list_transform(regexp_extract_all(text, '[a-z0-9]+'), lambda x: {STEM.format('x')}) AS stems FROM pr),
qg AS (SELECT product_id, category, text, {_stems(dims.GENDER_WORDS['hombre'])} AS man, {_stems(dims.GENDER_WORDS['mujer'])} AS woman, category = 'moda' AND {_stems(dims.CHILD_WORDS)} AS child FROM qr),
qq AS (SELECT product_id, token, row_number() OVER () AS pos FROM (SELECT product_id, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS token FROM pr) WHERE length(token) >= 3 AND token NOT IN ({_list(dims.RANKING_STOP_WORDS)})),
m AS (SELECT product_id, pos, leaf_id, max(sc.w) AS w FROM qq JOIN sc ON ({STEM.format('qq.token')}) = ({STEM.format('sc.token')}) OR (length(qq.token) >= 4 AND length(sc.token) >= 4 AND (contains(qq.token, sc.token) OR contains(sc.token, qq.token))) GROUP BY ALL),
s AS (SELECT product_id, leaf_id, sum(w) AS score FROM m GROUP BY ALL),
pl AS (SELECT leaf_id, name, audience, p.platform, list_extract(p.ids, CAST(length(name) % len(p.ids) + 1 AS INTEGER)) AS root_id FROM lf, (VALUES ('vinted', {_roots('vinted')}), ('wallapop', {_roots('wallapop')})) p(platform, ids)),
j AS (SELECT product_id, platform, leaf_id, name, category, man, woman, child, audience, {_child_root} AS child_root, {_in_scope} AS inside, score FROM s JOIN pl USING (leaf_id) JOIN qg USING (product_id)),
f AS (SELECT product_id, platform, leaf_id, name, round(score * CASE WHEN man = woman OR audience NOT IN ('Mujer', 'Hombre') THEN 1.0 WHEN man = (audience = 'Hombre') THEN 1.7 ELSE 0.25 END * CASE WHEN NOT child THEN 1.0 WHEN child_root THEN 1.7 ELSE 0.4 END, 9) AS score FROM j WHERE category = 'otros' OR inside OR (child AND child_root)),
r AS (SELECT *, row_number() OVER (PARTITION BY product_id, platform ORDER BY score DESC, name, leaf_id) AS k FROM f)
SELECT product_id, platform, CAST(k AS INTEGER) AS rank, leaf_id, round(score, 5) AS score FROM r WHERE k <= 3
""")
def category_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three leaves of trees with the platforms' roots, for texts of every category with gender and child words."""
    p = derived.table(spark, sf_dir, "part")
    pick = lambda xs, i: F.get(F.array(*(F.lit(x) for x in xs)), i.cast("int"))
    own = p.select(F.col("p_partkey").alias("product_id"), pick(dims.CATEGORIES, F.col("p_size") % 5).alias("category"), F.concat_ws(" ", "p_name", "p_type", pick(AUDIENCE_WORDS, F.col("p_partkey") % 6)).alias("text"))
    return taxonomy.rank_categories(own, derived.rooted_leaves(spark, sf_dir)).select("product_id", "platform", "rank", "leaf_id", F.round("score", 5).alias("score"))


@query("""
SELECT 'geo' AS platform, n_nationkey + 100 AS leaf_id, n_name AS name, 'world/' || r_name AS path, 0 AS root_id FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a tree of regions and nations, walked from parent links."""
    r, n = derived.table(spark, sf_dir, "region"), derived.table(spark, sf_dir, "nation")
    nodes = r.select(F.lit("geo").alias("platform"), (F.col("r_regionkey") + 1).alias("id"), F.lit(0).alias("parent_id"), F.col("r_name").alias("name")).union(n.select(F.lit("geo"), F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, "n_name"))
    nodes = nodes.union(r.limit(1).select(F.lit("geo"), F.lit(0), F.lit(None).cast("int"), F.lit("world")))
    return taxonomy.tree_leaves(nodes).select("platform", "leaf_id", "name", F.array_join("path", "/").alias("path"), "root_id")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing fields of parts: some are missing, some were inferred."""
    p = derived.table(spark, sf_dir, "part")
    pick = lambda xs, i: F.get(F.array(*(F.lit(x) for x in xs)), i.cast("int"))
    k = F.col("p_partkey")
    made = (
        ("titulo", F.when(k % 10 != 0, F.lower(F.concat_ws(" ", "p_type", "p_name")))), ("descripcion", F.concat(F.lit("Articulo "), "p_name", F.lit(" en venta"))),
        ("categoria", pick(dims.CATEGORIES, F.col("p_size") % 5)), ("estado", F.when(k % 7 != 0, pick(list(dims.CHOICES), k % 6))), ("marca", F.when(k % 3 != 0, F.col("p_brand"))),
        ("talla", F.col("p_size").cast("string")), ("desperfectos", F.when(k % 11 == 0, F.lit("cremallera rota"))), ("color", F.when(k % 2 == 0, F.lit("azul"))),
    )
    rows = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value"), F.when((k + n) % 4 == 0, "inferido").otherwise("reviewer").alias("source"), F.lit("media").alias("confidence")) for n, (f, v) in enumerate(made)))
    return p.select(k.alias("product_id"), F.explode(rows).alias("x")).select("product_id", "x.*").filter((F.col("field") != "estado") | F.col("value").isNotNull())


FIELDS = f"""
WITH fl AS (SELECT p_partkey AS product_id, unnest([
  {{'f': 'titulo', 'v': CASE WHEN p_partkey % 10 <> 0 THEN lower(p_type || ' ' || p_name) END, 'n': 0}}, {{'f': 'descripcion', 'v': 'Articulo ' || p_name || ' en venta', 'n': 1}}, {{'f': 'categoria', 'v': list_extract([{_list(dims.CATEGORIES)}], CAST(p_size % 5 + 1 AS INTEGER)), 'n': 2}},
  {{'f': 'estado', 'v': CASE WHEN p_partkey % 7 <> 0 THEN list_extract([{_list(dims.CHOICES)}], CAST(p_partkey % 6 + 1 AS INTEGER)) END, 'n': 3}}, {{'f': 'marca', 'v': CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, 'n': 4}}, {{'f': 'talla', 'v': CAST(p_size AS VARCHAR), 'n': 5}},
  {{'f': 'desperfectos', 'v': CASE WHEN p_partkey % 11 = 0 THEN 'cremallera rota' END, 'n': 6}}, {{'f': 'color', 'v': CASE WHEN p_partkey % 2 = 0 THEN 'azul' END, 'n': 7}}]) AS o FROM part),
fields AS (SELECT product_id, o.f AS field, o.v AS value, CASE WHEN (product_id + o.n) % 4 = 0 THEN 'inferido' ELSE 'reviewer' END AS source, 'media' AS confidence FROM fl WHERE o.f <> 'estado' OR o.v IS NOT NULL)
"""


@query(FIELDS + """
SELECT product_id, field, value, source, confidence, NULL AS reason FROM fields
UNION ALL SELECT p_partkey, 'estado', NULL, 'inferido', 'baja', CASE WHEN p_partkey % 5 = 0 THEN 'synthesis_failed' ELSE 'older_version' END FROM part WHERE p_partkey % 7 = 0
""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every product, completed with its missing required ones."""
    failures = derived.table(spark, sf_dir, "part").filter(F.col("p_partkey") % 5 == 0).select(F.col("p_partkey").alias("product_id"), F.lit("vlm_sintesis: 429").alias("failure"))
    return listings.with_required(_fields(spark, sf_dir), failures)


@query(FIELDS + """
, ed AS (SELECT p_partkey AS product_id, 'marca' AS field, CASE WHEN p_partkey % 4 = 0 THEN '  ' WHEN p_partkey % 4 = 1 THEN p_brand ELSE 'Otra' END AS v FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 4 = 1),
j AS (SELECT f.*, e.field IS NOT NULL AS edited, nullif(trim(e.v), '') AS new FROM fields f LEFT JOIN ed e USING (product_id, field)), v AS (SELECT *, CASE WHEN edited THEN new ELSE value END AS now, edited AND new IS DISTINCT FROM value AS touched FROM j)
SELECT product_id, field, now AS value, CASE WHEN touched THEN 'reviewer' ELSE source END AS source, CASE WHEN NOT touched THEN confidence WHEN now IS NULL THEN 'baja' WHEN product_id % 9 = 0 THEN 'media' ELSE 'alta' END AS confidence, touched FROM v
""")
def reviewed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields after a block review with edits of the brand; every ninth product has a coherence warning."""
    p = derived.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    edits = p.filter((k % 2 == 0) | (k % 4 == 1)).select(k.alias("product_id"), F.lit("marca").alias("field"), F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.col("p_brand")).otherwise("Otra").alias("value"))
    warned = p.filter(k % 9 == 0).select(k.alias("product_id"))
    return listings.apply_review(_fields(spark, sf_dir), edits, warned, block=True)


@query(FIELDS + """
SELECT product_id, list_contains(list(field) FILTER (value IS NOT NULL), 'titulo') AND list_contains(list(field), 'estado') AS ok,
  nullif(concat_ws('; ', CASE WHEN NOT list_contains(list(field), 'estado') THEN 'missing:estado' END, CASE WHEN NOT list_contains(list(field) FILTER (value IS NOT NULL), 'titulo') THEN 'missing:titulo' END,
    CASE WHEN regexp_matches(max(value) FILTER (field = 'titulo'), '#') THEN 'title:UNALLOWED_SYMBOLS' END), '') AS reason FROM fields GROUP BY product_id
""")
def confirmation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which listings can be confirmed, and why the others can't."""
    done, failed = listings.confirm_listings(listings.pivoted(_fields(spark, sf_dir)))
    return listings.run_report(done, failed)


def _payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wide = listings.pivoted(_fields(spark, sf_dir))
    k = F.col("product_id")
    extra = wide.withColumn("confirmed", k % 8 != 0).withColumn("reference", F.when(k % 2 == 0, k)).withColumn("coherence_warning", F.when(k % 9 == 0, "mixed")).withColumn("photos", F.transform(F.sequence(F.lit(1), (k % 25 + 1).cast("int")), lambda i: k * 100 + i))
    photos = extra.select(F.explode("photos").alias("photo_id")).select("photo_id", F.when(F.col("photo_id") % 97 != 0, F.concat(F.lit("/p/"), F.col("photo_id").cast("string"))).alias("path"))
    return listings.build_payload(extra, photos)


@query(FIELDS + """
, w AS (SELECT p_partkey AS product_id, max(value) FILTER (field = 'titulo') AS titulo, max(value) FILTER (field = 'estado') AS estado, max(value) FILTER (field = 'categoria') AS categoria, max(value) FILTER (field = 'marca') AS marca, max(value) FILTER (field = 'color') AS color, max(value) FILTER (field = 'desperfectos') AS desp FROM part JOIN fields ON product_id = p_partkey GROUP BY p_partkey)
SELECT product_id, platform, CASE WHEN platform = 'vinted' THEN coalesce(marca, 'Sin marca') ELSE marca END AS brand, 4 + (color IS NOT NULL)::INT + (desp IS NOT NULL)::INT AS n_fields,
  least(product_id % 25 + 1, CASE WHEN platform = 'vinted' THEN 20 ELSE 10 END) - len(list_filter(range(1, least(product_id % 25 + 1, CASE WHEN platform = 'vinted' THEN 20 ELSE 10 END) + 1), lambda i: (product_id * 100 + i) % 97 = 0)) AS n_photos
FROM w, (VALUES ('vinted'), ('wallapop')) p(platform) WHERE product_id % 8 <> 0 AND titulo IS NOT NULL AND length(titulo) <= 100 AND NOT contains(titulo, '#')
""")
def export_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of every confirmed and clean listing on either platform."""
    done, _ = _payloads(spark, sf_dir)
    brand = F.get(F.filter("fields", lambda f: f["name"] == "marca"), F.lit(0))["value"]
    return done.select("product_id", "platform", brand.alias("brand"), F.size("fields").alias("n_fields"), F.size("included").cast("long").alias("n_photos"))


@query()
def payload_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every payload in the order of its platform's form."""
    return listings.payload_blocks(_payloads(spark, sf_dir)[0])


@query()
def blocked_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that are not exported, with reasons."""
    return _payloads(spark, sf_dir)[1].select("product_id", "platform", F.array_join("reasons", ",").alias("reasons"))


@query("""
SELECT p_partkey AS product_id, 'marca' AS field, p_brand AS value FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'talla', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 6 <> 0
""")
def stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from JSON: inferred ones, bad boxes and corrupt records are left out."""
    p = derived.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    brand = F.struct(F.lit("marca").alias("field"), F.col("p_brand").alias("value"), F.when(k % 4 == 0, "inferido").otherwise("reviewer").alias("source"), F.lit("alta").alias("confidence"), F.lit(None).cast("string").alias("photo"), F.lit(None).cast("array<int>").alias("box"))
    size = F.struct(F.lit("talla").alias("field"), F.col("p_size").cast("string").alias("value"), F.lit("foto").alias("source"), F.lit("media").alias("confidence"), F.lit("a.jpg").alias("photo"), F.array(F.lit(1), F.lit(2), F.lit(3), F.when(k % 6 == 0, -1).otherwise(4)).alias("box"))
    rows = p.select(k.alias("product_id"), F.explode(F.array(brand, size)).alias("x")).select("product_id", "x.*")
    stored = ingest.stored_json(rows)
    broken = stored.withColumn("fields_json", F.when(F.col("product_id") % 5 == 0, F.concat(F.lit("{"), "fields_json")).otherwise(F.col("fields_json")))
    return ingest.stored_fields(broken).select("product_id", "field", "value")


@query("""
SELECT o_custkey AS query, o_orderkey AS rank_key, CAST(round(o_totalprice, 2) AS DOUBLE) AS price FROM orders WHERE o_orderkey % 5 IN (0, 1, 2)
""")
def parsed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listing payloads, an item a body: prices as numbers or objects count, booleans and missing slugs don't."""
    o = derived.table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.round("o_totalprice", 2).cast("string")
    shown = F.when(k % 5 == 0, price).when(k % 5 == 1, F.concat(F.lit('{"amount":'), price, F.lit("}"))).when(k % 5 == 2, F.concat(F.lit('{"cash":'), price, F.lit("}"))).when(k % 5 == 3, "true").otherwise(price)
    slug = F.when(k % 5 == 4, F.lit("")).otherwise(F.concat(F.lit('"web_slug":"s'), k.cast("string"), F.lit('",')))
    body = F.concat(F.lit('{"data":{"section":{"payload":{"items":[{'), slug, F.lit('"title":"x","price":'), shown, F.lit("}]}}}}"))
    rows = o.select(F.concat_ws("/", F.col("o_custkey").cast("string"), k.cast("string")).alias("query"), body.alias("body"))
    out = ingest.listings_of(rows)
    return out.select(F.split("query", "/")[0].cast("long").alias("query"), F.split("query", "/")[1].cast("long").alias("rank_key"), "price")


CELLS = """
WITH tr AS (SELECT doc_id AS product, 'marca' AS field, CASE WHEN quality = 1 AND toxic = 0 THEN 'LEGIBLE_TEXTO' WHEN quality = 1 THEN 'LEGIBLE_VISUAL' WHEN doc_id % 2 = 0 THEN 'PRESENTE_ILEGIBLE' ELSE 'NO_FOTOGRAFIADO' END AS label, 'V' || (doc_id % 5) AS legible FROM labels),
pr AS (SELECT doc_id AS product, CASE WHEN doc_id % 3 = 0 THEN 'v' || (doc_id % 10) END AS value, CASE WHEN doc_id % 6 = 0 THEN 'alta' ELSE 'media' END AS confidence, 'V' || (doc_id % 4) AS reading, doc_id % 7 = 0 AS has_crop FROM documents),
cl AS (SELECT product, label, CASE WHEN label NOT LIKE 'LEGIBLE%' THEN CASE WHEN value IS NULL THEN 'abstain_ok' WHEN confidence = 'alta' THEN 'hallucination_high' ELSE 'hallucination' END
  WHEN value IS NOT NULL THEN CASE WHEN upper(value) = legible THEN 'hit' ELSE 'misread' END WHEN reading = legible THEN 'in_readings' WHEN has_crop THEN 'crop_only' ELSE 'lost' END AS class FROM tr LEFT JOIN pr USING (product))
"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, d = derived.table(spark, sf_dir, "labels"), derived.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    none = F.expr("CAST(array() AS array<string>)")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "LEGIBLE_TEXTO").when(F.col("quality") == 1, "LEGIBLE_VISUAL").when(k % 2 == 0, "PRESENTE_ILEGIBLE").otherwise("NO_FOTOGRAFIADO")
    truth = lab.select(k.alias("product"), F.lit("marca").alias("field"), label.alias("label"), F.concat(F.lit("V"), (k % 5).cast("string")).alias("legible_value"), none.alias("candidates"))
    predicted = d.select(k.alias("product"), F.lit("marca").alias("field"), F.when(k % 3 == 0, F.concat(F.lit("v"), (k % 10).cast("string"))).alias("value"), F.when(k % 6 == 0, "alta").otherwise("media").alias("confidence"), none.alias("alternatives"), F.array(F.concat(F.lit("V"), (k % 4).cast("string"))).alias("readings"), (k % 7 == 0).alias("has_crop"))
    return evals.classify_cells(truth, predicted)


@query(CELLS + "SELECT label, class, count(*) AS n FROM cl GROUP BY ALL")
def cell_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction cells by label and class."""
    return _cells(spark, sf_dir).groupBy("label", "class").agg(F.count(F.lit(1)).alias("n"))


@query(CELLS + "SELECT count(*) AS n, count(*) FILTER (class = 'hit') AS hits, count(*) FILTER (class LIKE 'hallucination%') AS hallucinations, count(*) FILTER (class = 'hallucination_high') AS hallucinations_high FROM cl")
def cell_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and hallucinations over all cells."""
    return evals.cell_rates(_cells(spark, sf_dir)).select("n", "hits", "hallucinations", "hallucinations_high")


@query("""
WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'Talla ' || source ELSE source END AS title FROM documents)
SELECT doc_id AS product_id, title, CASE WHEN doc_id % 3 = 0 THEN 'extract' WHEN doc_id % 4 = 0 THEN 'done' ELSE 'confirm' END AS queue FROM q
""")
def work_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work queue and stored title of documents as products with nested, flat or no fields."""
    d = derived.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    nested = F.concat(F.lit('{"campos":{"titulo":{"valor":"Talla '), "source", F.lit('"}},"confirmada":'), F.when(k % 4 == 0, "true").otherwise("false"), F.lit("}"))
    flat = F.concat(F.lit('{"campos":{},"titulo":{"valor":"'), "source", F.lit('"},"confirmada":'), F.when(k % 4 == 0, "true").otherwise("false"), F.lit("}"))
    rows = d.select(k.alias("product_id"), F.when(k % 3 == 0, "{broken").when(k % 3 == 1, nested).otherwise(flat).alias("fields_json"))
    out = listings.work_queues(listings.queue_flags(rows))
    return out.select("product_id", listings.stored_title(F.col("fields_json")).alias("title"), "queue")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as OCR regions of one photo for every three turns."""
    c = derived.table(spark, sf_dir, "conversations")
    t = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("Model: AB"), (F.col("conv_id") % 50).cast("string"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("product_id"), F.concat(F.lit("f"), F.floor(F.col("turn") / 3).cast("string")).alias("photo"), F.floor(F.col("turn") / 3).cast("int").alias("photo_seq"), F.col("turn").cast("int").alias("region_seq"), (F.col("turn") * 30 % 700).cast("int").alias("x"), (F.col("turn") * 130 % 900).cast("int").alias("y"), F.lit(200).alias("w"), F.lit(40).alias("h"), t.alias("text"), F.lit(0.9).alias("score"))


@query()
def region_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every OCR region: ruler, shortcut, long, repeat or read."""
    return readings.plan_regions(_regions(spark, sf_dir)).select("product_id", "photo", "region_seq", "plan", "value")


@query()
def region_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to read, merged by nearness and capped for each product, as keyed requests."""
    plan = readings.plan_regions(_regions(spark, sf_dir)).filter("plan = 'read'")
    merged = readings.capped_requests(readings.merged_regions(readings.region_clusters(plan))).withColumn("photo_hash", F.sha2("photo", 256))
    samples = merged.select("product_id", "photo_hash", F.col("photo_seq").alias("position")).distinct()
    return usage.plan_requests(merged, samples, "small", "v1", "read the label")


@query()
def reading_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that do not resemble the raw OCR text behind them."""
    r = derived.readings(spark, sf_dir).withColumn("raw_ocr", F.when(F.col("seq") % 2 == 0, F.reverse("text")).otherwise(F.col("text")))
    return readings.doubtful(r)


@query()
def gap_filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved fields with gaps filled from a synthesis that cites readings."""
    r = derived.readings(spark, sf_dir)
    said = r.groupBy("product_id").agg(F.min_by("text", "seq").alias("cited_text")).select("product_id", F.explode(F.array(F.lit("marca"), F.lit("modelo"))).alias("field"), F.col("cited_text").alias("value"), F.lit(True).alias("visible"), "cited_text", F.lit("media").alias("confidence"))
    return readings.fill_gaps(readings.resolve(r), said, r).drop("box")


@query()
def suggested_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editable search variants from attributes of any source."""
    return pricing.suggested_variants(pricing.with_garment(derived.attributes(spark, sf_dir)))
