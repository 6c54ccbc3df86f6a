"""Queries over photos: grouping, seams, rhythm, duplicates, order, pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.operators import dedupe, evals, grouping, ordering, pixels
from listingops.plans.registry import query
from listingops.sources import derived, dims, ingest

GAP_S = 43_200.0  # events are sparse; half a day splits them into a few thousand groups

PHOTOS = """
photos AS (
  SELECT user_id AS lot_id, event_id AS photo_id, 'IMG_' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.jpg' AS name,
    CASE WHEN event_type NOT IN ('signup', 'error') THEN ts END AS captured_at, event_type <> 'error' AS readable FROM events)
"""
GROUPED = f"""
WITH {PHOTOS}, dated AS (
  SELECT *, epoch_us(captured_at) AS t, lag(epoch_us(captured_at)) OVER w AS p FROM photos WHERE readable AND captured_at IS NOT NULL
  WINDOW w AS (PARTITION BY lot_id ORDER BY captured_at, name)
), cut AS (
  SELECT *, (t - p) / 1e6 AS gap, CASE WHEN (t - p) / 1e6 >= {GAP_S} THEN 1 ELSE 0 END AS c FROM dated
), run AS (
  SELECT *, sum(c) OVER (PARTITION BY lot_id ORDER BY captured_at, name ROWS UNBOUNDED PRECEDING) AS run,
    count(*) OVER (PARTITION BY lot_id) AS n, max(gap) OVER (PARTITION BY lot_id) AS most FROM cut
), grp AS (
  SELECT lot_id, photo_id, 'dated' AS section, CASE WHEN most = 0 THEN 'p:' || photo_id ELSE 'g:' || CAST(run AS BIGINT) END AS group_key, t, CASE WHEN c = 0 THEN gap END AS gap, n, most FROM run
  UNION ALL
  SELECT lot_id, photo_id, CASE WHEN readable THEN 'undated' ELSE 'unreadable' END, 'p:' || photo_id, NULL, NULL, NULL, NULL FROM photos WHERE NOT readable OR captured_at IS NULL)
"""


@query(GROUPED + """
SELECT lot_id, section, group_key, count(*) AS size, (max(t) - min(t)) / 1e6 AS duration_s, max(gap) AS largest_gap_s,
  CASE WHEN section = 'dated' AND count(*) > 1 THEN 'media' ELSE 'baja' END AS confidence,
  CASE WHEN section <> 'dated' THEN section WHEN max(most) = 0 THEN 'same_time' WHEN max(n) = 1 THEN 'single_dated' WHEN count(*) = 1 THEN 'single' ELSE 'burst' END AS reason_code
FROM grp GROUP BY lot_id, section, group_key
""")
def photo_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of every lot split into proposed products."""
    return grouping.group_photos(derived.photos(spark, sf_dir), GAP_S).select("lot_id", "section", "group_key", "size", "duration_s", "largest_gap_s", "confidence", "reason_code")


@query(GROUPED + """
, g AS (SELECT lot_id, group_key, section, min(t) AS s, max(t) AS e FROM grp WHERE section = 'dated' GROUP BY ALL),
p AS (SELECT lot_id, group_key, (lead(s) OVER (PARTITION BY lot_id ORDER BY s, group_key) - e) / 1e6 AS pause_s FROM g)
SELECT lot_id, count(*) AS pauses, count(*) FILTER (pause_s >= 604800) AS long_pauses, max(pause_s) AS longest FROM p WHERE pause_s IS NOT NULL GROUP BY lot_id
""")
def long_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pauses between neighbouring groups of a lot are a week or longer."""
    groups = grouping.long_pauses(grouping.group_photos(derived.photos(spark, sf_dir), GAP_S), 604_800.0)
    return groups.filter("pause_s IS NOT NULL").groupBy("lot_id").agg(F.count(F.lit(1)).alias("pauses"), F.count_if("long_pause").alias("long_pauses"), F.max("pause_s").alias("longest"))


def _assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo in curation order, with its group as product; every ninth photo has none."""
    p = derived.photos(spark, sf_dir)
    order = grouping.curation_order(p).select("lot_id", "photo_id", "pos")
    groups = grouping.grouped_photos(p, GAP_S).select("lot_id", "photo_id", F.col("group_key").alias("product_id"))
    return order.join(groups, ["lot_id", "photo_id"]).withColumn("product_id", F.when(F.col("photo_id") % 9 != 0, F.col("product_id")))


ASSIGNED = GROUPED + """
, ordered AS (SELECT lot_id, photo_id, row_number() OVER (PARTITION BY lot_id ORDER BY captured_at NULLS FIRST, name) AS pos FROM photos),
asg AS (SELECT o.lot_id, o.photo_id, o.pos, CASE WHEN o.photo_id % 9 <> 0 THEN g.group_key END AS product_id FROM ordered o JOIN grp g USING (lot_id, photo_id)),
near AS (SELECT *, lead(photo_id) OVER w AS right_id, lead(product_id) OVER w AS np FROM asg WINDOW w AS (PARTITION BY lot_id ORDER BY pos)),
seams AS (SELECT lot_id, photo_id AS left_id, right_id FROM near WHERE right_id IS NOT NULL AND NOT coalesce(product_id = np, false))
"""


@query(ASSIGNED + "SELECT lot_id, left_id, right_id FROM seams")
def open_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring photos that a saved assignment keeps apart."""
    return grouping.open_seams_of(_assignment(spark, sf_dir))


@query(ASSIGNED + """
, edited AS (SELECT * FROM seams WHERE left_id % 4 <> 0 UNION SELECT lot_id, photo_id, right_id FROM near WHERE right_id IS NOT NULL AND photo_id % 10 = 0),
cuts AS (SELECT a.lot_id, a.photo_id, a.pos, CASE WHEN e.left_id IS NULL THEN 0 ELSE 1 END AS c FROM (SELECT *, lag(photo_id) OVER (PARTITION BY lot_id ORDER BY pos) AS l FROM asg) a LEFT JOIN edited e ON e.lot_id = a.lot_id AND e.left_id = a.l AND e.right_id = a.photo_id),
parts AS (SELECT lot_id, photo_id, CAST(sum(c) OVER (PARTITION BY lot_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM cuts)
SELECT lot_id, part, count(*) AS photos, min(photo_id) AS first_photo FROM parts GROUP BY lot_id, part
""")
def seam_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every lot after a batch of merges (left id divisible by 4) and splits (by 10)."""
    own = _assignment(spark, sf_dir)
    seams = grouping.open_seams_of(own)
    pairs = grouping.open_seams_of(own.withColumn("product_id", F.lit(None)))
    log = seams.filter(F.col("left_id") % 4 == 0).select("lot_id", "left_id", "right_id", F.lit(1).alias("seq"), F.lit("close").alias("action"))
    log = log.union(pairs.filter(F.col("left_id") % 10 == 0).select("lot_id", "left_id", "right_id", F.lit(2), F.lit("open")))
    edited = grouping.edited_seams(seams, log)
    parts = grouping.partition_by_seams(own, edited)
    return parts.groupBy("lot_id", "part").agg(F.count(F.lit(1)).alias("photos"), F.min("photo_id").alias("first_photo"))


@query(ASSIGNED + """
SELECT DISTINCT lot_id, product_id FROM near WHERE product_id = np AND photo_id % 6 = 0
""")
def manual_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved groups that hold a pair which the proposal (pairs with a left id divisible by 6) leaves open."""
    own = _assignment(spark, sf_dir)
    pairs = grouping.open_seams_of(own.withColumn("product_id", F.lit(None)))
    return grouping.manually_merged(own, pairs.filter(F.col("left_id") % 6 == 0))


PROPOSAL = f"""
WITH {PHOTOS}, base AS (SELECT lot_id, photo_id, readable, photo_id % 50 = 0 AS confirmed FROM photos),
prop AS (
  SELECT lot_id, photo_id % 7 AS group_id, photo_id FROM base WHERE photo_id % 3 = 0
  UNION ALL SELECT lot_id, 8, photo_id FROM base WHERE photo_id % 99 = 0
  UNION ALL SELECT lot_id, 9, CASE WHEN photo_id % 400 = 0 THEN -photo_id END FROM base WHERE photo_id % 200 = 0),
known AS (SELECT p.*, b.readable, b.confirmed FROM prop p LEFT JOIN base b USING (lot_id, photo_id) WHERE photo_id IS NOT NULL)
SELECT lot_id, rule, item FROM (
  SELECT DISTINCT lot_id, 'empty_group' AS rule, CAST(group_id AS VARCHAR) AS item FROM prop WHERE photo_id IS NULL
  UNION SELECT lot_id, 'photo_twice', CAST(photo_id AS VARCHAR) FROM prop WHERE photo_id IS NOT NULL GROUP BY lot_id, photo_id HAVING count(DISTINCT group_id) > 1
  UNION SELECT lot_id, 'unknown_photo', CAST(photo_id AS VARCHAR) FROM known WHERE readable IS NULL
  UNION SELECT lot_id, 'confirmed_photo', CAST(photo_id AS VARCHAR) FROM known WHERE confirmed
  UNION SELECT lot_id, 'unreadable_mixed', CAST(group_id AS VARCHAR) FROM known WHERE readable IS NOT NULL GROUP BY lot_id, group_id HAVING count(*) > 1 AND count(*) FILTER (NOT readable) > 0)
"""


def _proposal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = derived.photos(spark, sf_dir).select("lot_id", "photo_id", "readable", (F.col("photo_id") % 50 == 0).alias("confirmed"))
    one = base.filter(F.col("photo_id") % 3 == 0).select("lot_id", (F.col("photo_id") % 7).alias("group_id"), "photo_id")
    two = base.filter(F.col("photo_id") % 99 == 0).select("lot_id", F.lit(8).cast("long"), "photo_id")
    three = base.filter(F.col("photo_id") % 200 == 0).select("lot_id", F.lit(9).cast("long"), F.when(F.col("photo_id") % 400 == 0, -F.col("photo_id")))
    return one.union(two).union(three), base


@query(PROPOSAL)
def proposal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a lot's proposal from being saved."""
    return grouping.proposal_violations(*_proposal(spark, sf_dir))


@query(f"""
WITH {PHOTOS}, d AS (SELECT lot_id, photo_id, (epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (PARTITION BY lot_id ORDER BY captured_at, name)) / 1e6 AS gap FROM photos WHERE captured_at IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY gap, photo_id) - 1 AS i, count(*) OVER (PARTITION BY lot_id) AS n, median(gap) OVER (PARTITION BY lot_id) AS med FROM d WHERE gap IS NOT NULL)
SELECT lot_id, max(n) + 1 AS n_dated, max(CASE WHEN i = floor(0.1 * (n - 1)) THEN gap END) AS p10, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN gap END) AS p50, max(CASE WHEN i = floor(0.9 * (n - 1)) THEN gap END) AS p90,
  round(stddev_samp(CASE WHEN gap <= med THEN gap END), 3) AS jitter_s FROM g GROUP BY lot_id HAVING max(n) >= 2
""")
def shooting_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap quantiles and jitter of every lot."""
    out = grouping.rhythm(derived.photos(spark, sf_dir)).filter("n_dated >= 3")
    return out.select("lot_id", "n_dated", "p10", "p50", "p90", F.round("jitter_s", 3).alias("jitter_s"))


@query(f"""
WITH {PHOTOS}, th AS (SELECT unnest([3600.0, 21600.0, 43200.0, 86400.0]) AS threshold_s),
d AS (SELECT lot_id, photo_id, captured_at, photo_id // 5 AS true_id, (epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (PARTITION BY lot_id ORDER BY captured_at, photo_id)) / 1e6 AS gap FROM photos WHERE captured_at IS NOT NULL),
r AS (SELECT threshold_s, lot_id, photo_id, true_id, sum(CASE WHEN gap >= threshold_s THEN 1 ELSE 0 END) OVER (PARTITION BY threshold_s, lot_id ORDER BY captured_at, photo_id ROWS UNBOUNDED PRECEDING) AS run FROM d, th),
f AS (SELECT threshold_s, count(*) AS n_groups, count(*) FILTER (k > 1) AS fusions FROM (SELECT threshold_s, lot_id, run, count(DISTINCT true_id) AS k FROM r GROUP BY ALL) GROUP BY threshold_s),
o AS (SELECT threshold_s, CAST(sum(k - 1) AS BIGINT) AS over_cuts FROM (SELECT threshold_s, true_id, count(DISTINCT (lot_id, run)) AS k FROM r GROUP BY ALL) GROUP BY threshold_s)
SELECT CAST(f.threshold_s AS DOUBLE) AS threshold_s, n_groups, fusions, over_cuts FROM f JOIN o USING (threshold_s)
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusions and over-cuts for four gap thresholds, with runs of five event ids as truth."""
    p = derived.photos(spark, sf_dir).filter("captured_at IS NOT NULL").withColumn("true_id", F.floor(F.col("photo_id") / 5))
    return evals.sweep(p, spark.createDataFrame([(x,) for x in (3600.0, 21600.0, 43200.0, 86400.0)], "threshold_s double"))


HASHES = """
WITH own AS (SELECT vec_id AS photo_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS s FROM embeddings),
rows1 AS (SELECT photo_id, array_to_string(s[1:12], '') AS sha256, array_to_string(s, '') AS bits FROM own),
hashes AS (SELECT * FROM rows1 UNION ALL SELECT photo_id + 1000000000, sha256, bits[1:63] || CASE WHEN bits[64] = '1' THEN '0' ELSE '1' END FROM rows1 WHERE photo_id % 7 = 0)
"""


@query(HASHES + "SELECT sha256, count(*) AS n, min(photo_id) AS first_id FROM hashes GROUP BY sha256 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that two or more photos share."""
    return dedupe.exact_duplicates(derived.hashes(spark, sf_dir))


@query(HASHES + ", d AS (SELECT sha256, min(photo_id) AS first_id FROM hashes GROUP BY sha256 HAVING count(*) > 1) SELECT sha256, photo_id, first_id FROM hashes JOIN d USING (sha256)")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo of the contents that two or more share."""
    return dedupe.duplicate_members(derived.hashes(spark, sf_dir))


@query(HASHES + """
, v AS (SELECT bits, min(photo_id) AS head FROM hashes GROUP BY bits)
SELECT * FROM (
  SELECT x.head AS a, y.head AS b, CAST(hamming(x.bits, y.bits) AS INTEGER) AS distance FROM v x JOIN v y ON x.head < y.head WHERE hamming(x.bits, y.bits) <= 5
  UNION ALL SELECT v.head, h.photo_id, 0 FROM hashes h JOIN v USING (bits) WHERE h.photo_id <> v.head)
""")
def near_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of photos whose perceptual hashes are at most five bits apart."""
    return dedupe.near_duplicates(derived.hashes(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as photos of sources: every sixth source lacks scores."""
    d = derived.table(spark, sf_dir, "documents")
    group = F.concat("source", F.lit("-"), (F.col("doc_id") % 40).cast("string"))
    return d.select(group.alias("product_id"), F.col("doc_id").alias("photo_id"), F.concat(F.lit("n"), F.lpad((F.col("doc_id") * 7 % 1000).cast("string"), 4, F.lit("0"))).alias("name"), F.when(~((F.col("doc_id") % 40 == 3) & (F.col("doc_id") % 3 == 0)), F.col("n_chars").cast("double")).alias("sharpness"), F.when(F.col("doc_id") % 2 == 0, F.timestamp_seconds(F.col("n_chars"))).alias("captured_at"), F.when(F.col("doc_id") % 5 == 0, F.timestamp_seconds(F.col("n_chars") + 1)).alias("mtime"), F.concat(F.lit("/p/"), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("path"), F.when(F.col("doc_id") % 40 != 5, F.concat(F.lit("item-"), (F.col("doc_id") % 40).cast("string"))).otherwise("a/b").alias("slug"))


SCORED = """
WITH p AS (SELECT source || '-' || (doc_id % 40) AS product_id, doc_id AS photo_id, 'n' || lpad(CAST(doc_id * 7 % 1000 AS VARCHAR), 4, '0') AS name,
  CASE WHEN NOT (doc_id % 40 = 3 AND doc_id % 3 = 0) THEN n_chars END AS sharpness, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS c, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 END AS m,
  CASE WHEN doc_id % 40 <> 5 THEN 'item-' || (doc_id % 40) ELSE 'a/b' END AS slug FROM documents),
q AS (SELECT *, CASE WHEN count(*) FILTER (sharpness IS NULL) OVER (PARTITION BY product_id) = 0 THEN 'sharpness' ELSE 'chronological' END AS criterion FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN criterion = 'sharpness' THEN -sharpness END NULLS FIRST, CASE WHEN criterion = 'sharpness' OR c IS NOT NULL THEN 0 WHEN m IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN criterion = 'chronological' THEN coalesce(c, m) END NULLS FIRST, name, photo_id) AS position FROM q)
"""


@query(SCORED + "SELECT product_id, photo_id, CAST(position AS INTEGER) AS position, criterion FROM o")
def photo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of every product in the suggested order."""
    return ordering.suggested_order(_scored(spark, sf_dir)).select("product_id", "photo_id", "position", "criterion")


@query(SCORED + """
, l AS (SELECT o.*, platform, lim, max(position) OVER (PARTITION BY product_id, platform) AS most FROM o, (VALUES ('wallapop', 10), ('vinted', 20)) t(platform, lim))
SELECT product_id, platform, photo_id, CASE WHEN position <= lim AND slug <> 'a/b' THEN slug || '_' || lpad(CAST(position AS VARCHAR), CAST(greatest(2, length(CAST(least(most, 20) AS VARCHAR))) AS INTEGER), '0') || '.jpg' END AS target,
  position <= lim AS included, CASE WHEN slug = 'a/b' THEN 'bad_slug' WHEN position > lim THEN 'over_limit' END AS problem FROM l
""")
def photo_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export file names of every product's photos on both platforms."""
    return ordering.manifest(ordering.suggested_order(_scored(spark, sf_dir)))


@query(SCORED + """
, s AS (SELECT product_id, photo_id, row_number() OVER (PARTITION BY product_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY product_id) AS n FROM o)
SELECT product_id, photo_id FROM s WHERE n <= 3 OR i IN (0, CAST(round_even((n - 1) / 2.0, 0) AS BIGINT), n - 1)
""")
def photo_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three photos of every product, spread over its sequence."""
    return ordering.even_sample(ordering.suggested_order(_scored(spark, sf_dir))).select("product_id", "photo_id")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels of 40-wide images by supplier."""
    w = F.col("l_orderkey") % 40
    return derived.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("photo_id"), w.cast("int").alias("x"), (F.col("l_partkey") % 40).cast("int").alias("y"), F.floor(F.col("l_quantity") * 5).cast("int").alias("r"), (F.floor(F.col("l_extendedprice")) % 256).cast("int").alias("g"), F.floor(F.col("l_discount") * 1000).cast("int").alias("b"))


PIXELS = """
WITH px AS (SELECT l_suppkey AS photo_id, l_orderkey % 40 AS x, l_partkey % 40 AS y, CAST(floor(l_quantity * 5) AS INTEGER) AS r, CAST(floor(l_extendedprice) AS BIGINT) % 256 AS g, CAST(floor(l_discount * 1000) AS INTEGER) AS b FROM lineitem),
sz AS (SELECT photo_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY photo_id),
mid AS (SELECT px.* FROM px JOIN sz USING (photo_id) WHERE x >= w // 2 - greatest(CAST(floor(w * 0.5 / 2) AS BIGINT), 1) AND x < w // 2 + greatest(CAST(floor(w * 0.5 / 2) AS BIGINT), 1) AND y >= h // 2 - greatest(CAST(floor(h * 0.5 / 2) AS BIGINT), 1) AND y < h // 2 + greatest(CAST(floor(h * 0.5 / 2) AS BIGINT), 1)),
kept AS (SELECT * FROM mid WHERE NOT (photo_id % 2 = 0 AND x BETWEEN 15 AND 20 AND y BETWEEN 10 AND 40)),
bins AS (SELECT photo_id, CAST(r // 32 * 32 + 16 AS INTEGER) AS r, CAST(g // 32 * 32 + 16 AS INTEGER) AS g, CAST(b // 32 * 32 + 16 AS INTEGER) AS b, count(*) AS n FROM kept GROUP BY ALL),
best AS (SELECT photo_id, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY n DESC, r, g, b) AS k FROM bins) WHERE k = 1)
"""


@query(PIXELS + "SELECT * FROM best")
def dominant_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant colour of every image's centre outside its masks."""
    px = pixels.central(_pixels(spark, sf_dir))
    masks = px.select("photo_id").distinct().filter(F.col("photo_id") % 2 == 0).select("photo_id", F.lit(15).alias("bx"), F.lit(10).alias("by"), F.lit(5).alias("bw"), F.lit(30).alias("bh"))
    return pixels.dominant_colour(pixels.unmasked(px, masks)).select("photo_id", "r", "g", "b")


_NAMES = ", ".join(f"({n}, '{x[0]}', {x[1]}, {x[2]}, {x[3]})" for n, x in enumerate(dims.PALETTE))
_LIN = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_ROOT = "CASE WHEN {0} > 0.008856 THEN pow({0}, 1 / 3.0::DOUBLE) ELSE {0} * 7.787 + 16 / 116.0::DOUBLE END"
_LAB = f"""
SELECT *, fy * 116 - 16 AS l, (fx - fy) * 500 AS a, (fy - fz) * 200 AS bb FROM (SELECT *, {_ROOT.format('x_')} AS fx, {_ROOT.format('y_')} AS fy, {_ROOT.format('z_')} AS fz FROM (
 SELECT *, (lr * 0.4124 + lg * 0.3576 + lb * 0.1805) / 0.95047 AS x_, lr * 0.2126 + lg * 0.7152 + lb * 0.0722 AS y_, (lr * 0.0193 + lg * 0.1192 + lb * 0.9505) / 1.08883 AS z_ FROM (
  SELECT *, {_LIN.format('r')} AS lr, {_LIN.format('g')} AS lg, {_LIN.format('b')} AS lb FROM {{0}})))
"""


NAMED = PIXELS + f"""
, c AS (SELECT photo_id, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM best), pal AS (SELECT ord, name, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM (VALUES {_NAMES}) t(ord, name, r, g, b)), cl AS ({_LAB.format('c')}), pl AS ({_LAB.format('pal')}),
d AS (SELECT cl.photo_id, pl.name, row_number() OVER (PARTITION BY cl.photo_id ORDER BY pow(cl.l - pl.l, 2) + pow(cl.a - pl.a, 2) + pow(cl.bb - pl.bb, 2), ord) AS k FROM cl, pl), named AS (SELECT photo_id, name AS colour FROM d WHERE k = 1)
"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = dominant_colours(spark, sf_dir)
    return pixels.named_colours(best.select("photo_id", *(F.col(c).cast("double").alias(c) for c in "rgb"))).select("photo_id", "colour")


@query(NAMED + "SELECT photo_id, colour FROM named")
def colour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant colour of every image by the nearest of sixteen names."""
    return _named(spark, sf_dir)


@query(NAMED + """
SELECT photo_id % 60 AS product_id, CASE WHEN count(DISTINCT colour) = 1 THEN min(colour) END AS value, 'inferido' AS source, CASE WHEN count(DISTINCT colour) = 1 THEN 'media' ELSE 'baja' END AS confidence,
  CASE WHEN count(DISTINCT colour) = 1 THEN 'one colour in all samples' ELSE 'several colours: ' || string_agg(DISTINCT colour, ', ' ORDER BY colour) END AS reason FROM named GROUP BY 1
""")
def colour_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One colour of every product by all its images, or none with the colours that they have."""
    return pixels.colour_consensus(_named(spark, sf_dir).withColumn("product_id", F.col("photo_id") % 60))


@query("""
WITH g AS (SELECT l_suppkey AS photo_id, l_partkey % 20 AS x, l_orderkey % 20 AS y, CAST(max(l_quantity) AS INTEGER) AS v FROM lineitem GROUP BY ALL),
e AS (SELECT photo_id, v, lag(v) OVER a + lead(v) OVER a + lag(v) OVER d + lead(v) OVER d - 4 * v AS q FROM g WINDOW a AS (PARTITION BY photo_id, y ORDER BY x), d AS (PARTITION BY photo_id, x ORDER BY y))
SELECT photo_id, round(var_pop(CASE WHEN q IS NULL THEN v ELSE least(255, greatest(0, q + 128)) END), 4) AS sharpness FROM e GROUP BY photo_id
""")
def photo_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplacian variance of grey grids by supplier."""
    grid = derived.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("photo_id"), (F.col("l_partkey") % 20).alias("x"), (F.col("l_orderkey") % 20).alias("y")).agg(F.max("l_quantity").cast("int").alias("v"))
    return pixels.sharpness(grid).select("photo_id", F.round("sharpness", 4).alias("sharpness"))


@query(f"""
WITH {PHOTOS}, r AS (SELECT lot_id, photo_id, readable, captured_at, '/lots/' || lot_id AS folder, CASE WHEN photo_id % 17 = 0 THEN '/other/' ELSE '/lots/' || lot_id || '/' END || (photo_id // 2 % 90) || '.jpg' AS path, photo_id % 23 <> 0 AS copied FROM photos),
n AS (SELECT *, row_number() OVER (PARTITION BY lot_id, path ORDER BY path, photo_id) AS k FROM r),
j AS (SELECT *, CASE WHEN NOT copied THEN 'not_copied' WHEN photo_id % 17 = 0 THEN 'outside_folder' WHEN k > 1 THEN 'registered_before' END AS reason FROM n)
SELECT lot_id, count(*) FILTER (reason IS NULL) AS photos, count(*) FILTER (reason IS NULL AND NOT readable) AS unreadable, count(*) FILTER (reason IS NULL AND captured_at IS NULL) AS undated, count(*) FILTER (reason IS NOT NULL) AS rejected FROM j GROUP BY lot_id
""")
def lot_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered and rejected photos of every lot."""
    p = derived.photos(spark, sf_dir)
    folder = F.concat(F.lit("/lots/"), F.col("lot_id").cast("string"))
    path = F.concat(F.when(F.col("photo_id") % 17 == 0, F.lit("/other/")).otherwise(F.concat(folder, F.lit("/"))), F.floor(F.col("photo_id") / 2 % 90).cast("string"), F.lit(".jpg"))
    rows = p.withColumn("folder", folder).withColumn("path", path).withColumn("copied", F.col("photo_id") % 23 != 0)
    return ingest.lot_counts(*ingest.registered(rows)).select("lot_id", "photos", "unreadable", "undated", "rejected")


@query(f"""
WITH {PHOTOS}, n AS (SELECT lot_id, photo_id, 'd' || photo_id || '/' AS dir, (photo_id % 5) || CASE WHEN photo_id % 7 < 2 THEN '_' || (photo_id % 4 + 1) ELSE '' END AS stem FROM photos),
r AS (SELECT *, row_number() OVER (PARTITION BY lot_id, stem ORDER BY dir || stem, photo_id) - 1 AS k FROM n),
free AS (SELECT b.lot_id, b.stem, g.g, row_number() OVER (PARTITION BY b.lot_id, b.stem ORDER BY g.g) AS k FROM (SELECT lot_id, stem, count(*) + 4 AS most FROM n GROUP BY ALL) b, LATERAL (SELECT unnest(range(1, b.most + 1)) AS g) g
  WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.lot_id = b.lot_id AND n.stem = b.stem || '_' || g.g))
SELECT r.lot_id, r.photo_id, CASE WHEN r.k = 0 THEN r.stem ELSE r.stem || '_' || free.g END || '.jpg' AS target FROM r LEFT JOIN free ON r.lot_id = free.lot_id AND r.stem = free.stem AND r.k = free.k
""")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target names of photos that share base names, some of which are numbered already."""
    stem = F.concat((F.col("photo_id") % 5).cast("string"), F.when(F.col("photo_id") % 7 < 2, F.concat(F.lit("_"), (F.col("photo_id") % 4 + 1).cast("string"))).otherwise(""))
    p = derived.photos(spark, sf_dir).select("lot_id", "photo_id", F.concat(F.lit("d"), F.col("photo_id").cast("string"), F.lit("/"), stem, F.lit(".jpg")).alias("path"))
    return ingest.free_names(p).select("lot_id", "photo_id", "target")


@query("""
SELECT event_id AS photo_id, CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) END AS captured_at FROM events
""")
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as cameras do and read back; every third is malformed."""
    e = derived.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" "), F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return e.select(F.col("event_id").alias("photo_id"), ingest.capture_time(raw).cast("timestamp_ntz").alias("captured_at"))
