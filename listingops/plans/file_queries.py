"""Queries over what is written and read again: reading payloads, reports, payload folders, guarded events, hash texts."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.functions import numbers as N
from listingops.operators import ledger, usage
from listingops.plans import record_queries  # noqa: F401  its SQL is read below
from listingops.plans.listing_queries import _payloads
from listingops.plans.registry import SQL, query
from listingops.plans.sales_queries import EVENTS, _ledger
from listingops.sources import derived, dims, ingest, reports
from listingops.sources.stored import shared_dir

_SQL_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_BODIES = f"""
WITH t AS (SELECT conv_id AS product_id, CAST(turn AS BIGINT) AS seq, text, length(text) AS n,
  CASE WHEN turn % 7 = 6 THEN 'elsewhere' ELSE {_SQL_LIST(dims.LOCATIONS)}[CAST(length(text) % {len(dims.LOCATIONS)} AS INTEGER) + 1] END AS location,
  {_SQL_LIST(dims.CONTENTS)}[CAST(turn % {len(dims.CONTENTS)} AS INTEGER) + 1] AS content FROM conversations),
b AS (SELECT *, n % 5 <> 0 AS legible, location <> 'elsewhere' AND n % 11 <> 0 AND n % 13 <> 0 AS ok FROM t)
"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer for every conversation turn: two findings, or none, or no JSON at all; some at unknown places."""
    c, n = derived.table(spark, sf_dir, "conversations"), F.length("text")
    names = lambda xs: F.array(*map(F.lit, xs))
    place = F.when(F.col("turn") % 7 == 6, "elsewhere").otherwise(F.get(names(dims.LOCATIONS), (n % len(dims.LOCATIONS)).cast("int")))
    content = F.get(names(dims.CONTENTS), (F.col("turn") % len(dims.CONTENTS)).cast("int"))
    found = F.array(F.struct(content.alias("content"), F.col("text")), F.struct(F.lit("otro").alias("content"), F.lit("  ").alias("text")))
    body = F.to_json(F.struct((n % 5 != 0).alias("legible"), F.lit(True).alias("belongs"), place.alias("location"), F.when(n % 11 != 0, found).otherwise(F.slice(found, 1, 0)).alias("findings")))
    return c.select(F.col("conv_id").alias("product_id"), F.col("turn").cast("long").alias("seq"), F.lit("f.jpg").alias("photo"), F.lit(None).cast("string").alias("raw_ocr"), F.when(n % 13 != 0, body).otherwise("{broken").alias("body"))


@query(_BODIES + """
SELECT product_id, seq, legible, location, content, CASE WHEN legible THEN nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') END AS text FROM b WHERE ok
UNION ALL SELECT product_id, seq, legible, location, 'otro', NULL FROM b WHERE ok
""")
def reading_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each finding of the answers that hold together; illegible ones without a text."""
    return ingest.reading_rows(_bodies(spark, sf_dir))[0].select("product_id", "seq", "legible", "location", "content", "text")


@query(_BODIES + "SELECT product_id, seq, 'invalid_payload' AS reason FROM b WHERE NOT ok")
def reading_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that are no JSON, name an unknown place or find nothing."""
    return ingest.reading_rows(_bodies(spark, sf_dir))[1]


@query(SQL["ledger_report"])
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger report, written as CSV in ledger order into a folder of its date, and read again."""
    path = reports.write_ledger(_ledger(spark, sf_dir), f"{shared_dir(spark)}/reports-{uuid.uuid4().hex[:12]}", datetime(2026, 5, 1))
    shape = ledger.report(_ledger(spark, sf_dir)).schema
    return spark.read.schema(shape).option("header", "true").csv(path).na.fill("")


@query(SQL["whole_payloads"])
def written_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payload, written nested in a directory for each platform, and read again in full."""
    done, _ = _payloads(spark, sf_dir)
    folder = f"{shared_dir(spark)}/payloads-{uuid.uuid4().hex[:12]}"
    reports.write_payloads(done, folder)
    return record_queries.in_full(spark.read.schema(done.schema).parquet(folder))


@query(EVENTS + """
, g AS (SELECT product_id, seq, type, CASE WHEN seq % 24 = 9 THEN -price_cents ELSE price_cents END AS price_cents, CASE WHEN seq % 28 = 12 THEN 'elsewhere' ELSE platform END AS platform FROM ev),
r AS (SELECT *, CASE WHEN price_cents < 0 THEN 'negative_cents' WHEN type IN ('published', 'sold') AND platform = 'elsewhere' THEN 'unknown_platform' END AS why FROM g),
s AS (SELECT *, last_value(CASE WHEN why IS NULL THEN CASE type WHEN 'sold' THEN true WHEN 'undo_sale' THEN false END END IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS standing FROM r)
SELECT product_id, seq, coalesce(why, 'no_sale') AS reason FROM s WHERE why IS NOT NULL OR (type IN ('undo_sale', 'returned') AND NOT coalesce(standing, false))
""")
def guarded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with negative cents or unknown platforms, and the returns of sales that were refused for it."""
    e = derived.events(spark, sf_dir)
    price = F.when(F.pmod("seq", F.lit(24)) == 9, -F.col("price_cents")).otherwise(F.col("price_cents"))
    place = F.when(F.pmod("seq", F.lit(28)) == 12, "elsewhere").otherwise(F.col("platform"))
    return ledger.checked_events(e.withColumn("price_cents", price).withColumn("platform", place))[1].select("product_id", "seq", "reason")


@query("""
WITH h AS (SELECT doc_id AS photo_id, CASE WHEN doc_id % 9 = 4 THEN 'no hash' ELSE left(md5(text), 16) END AS h FROM documents)
SELECT photo_id, CASE WHEN h <> 'no hash' THEN CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS VARCHAR) END AS bits FROM (SELECT *, CASE WHEN h <> 'no hash' THEN CAST(CAST('0x' || h AS UBIGINT) AS HUGEINT) END AS u FROM h)
""")
def photo_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash texts of every document as a photo, as 64 bits in decimal text; null where the text is no hash."""
    text = F.when(F.col("doc_id") % 9 == 4, "no hash").otherwise(F.substring(F.md5("text"), 1, 16))
    return derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id"), N.hash_bits(text).cast("string").alias("bits"))


@query("""
SELECT doc_id, sha256(concat_ws(chr(0), concat_ws(chr(1), md5(text), CASE WHEN doc_id % 2 = 0 THEN lang END), 'small', 'v1', left(text, 40))) AS key FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL
""")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which the answer to a request of one or two images is kept."""
    images = F.array_compact(F.array(F.md5("text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))))
    d = derived.table(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang IS NOT NULL")
    return d.select("doc_id", usage.request_key(images, F.lit("small"), F.lit("v1"), F.substring("text", 1, 40)).alias("key"))
