"""The queries that apply this subpackage's operators to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.llm import decontaminate, jaccard_join, license_scan, line_dedup, packing, quality, secrets_scan, sharding, simhash_join, spelling, token_alignment, topk_search, toxicity
from listingops.llm.common import table

CAPACITY, END_ID, SHARDS, THRESHOLD = 1024, 2, 8, 0.7


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: counts and digest of the rules' spans, and all spans with those of the Markov models."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets_scan.scan(docs, secrets_scan.fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of("markov").alias("n_markov"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, vocabulary(), CAPACITY, END_ID)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of documents that repeats a benchmark item: five-word shingles, weighted similarity of 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its number of three-word shingles and its component of links at 90 % or more."""
    joined = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100)
    return joined.select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id FROM w LEFT JOIN n USING (r) JOIN reach ON reach.a = w.r JOIN w o ON o.r = reach.b GROUP BY w.r, w.doc_id, n.n
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents in one of eight shards of near-equal bytes; equal texts share a shard."""
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents after line dedup: the deleted line ranges, and length and CRC of the text that is left."""
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ranges = F.array_join(F.transform("deleted_lines", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    gone = F.aggregate("deleted_lines", F.lit(0), lambda acc, x: acc + x["e"] - x["s"])
    return cleaned.select("doc_id", F.coalesce(gone, F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(ranges, F.lit("")).alias("deleted_lines"), F.length("text").cast("long").alias("kept_chars"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in documents of which the alignment covers 80 % or more."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its toxicity score, by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector over all other rows of embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk_search.quantised("embedding").alias("v")).filter(F.col("v").isNotNull())
    asked = vectors.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
    return topk_search.exact_top_k(vectors, asked, 10)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its importance weight and whether it is in the Gumbel top-k sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its SimHash of three-word shingles and its component of fingerprints two bits apart or less."""
    found = simhash_join.near_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the groups and links of its byte-level and piece tokens, and how common its links are."""
    return token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents of five letters or more that occurs three times or more, with the form that it is a variant of."""
    return spelling.spelling_forms(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_best_fit_packing, op3_decontamination, op4_jaccard_join, op5_sharding, op6_line_dedup, op7_license_scan, op8_toxicity, op9_exact_top_k, op10_quality, op11_simhash, op12_token_alignment, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4_SQL, "op9_exact_top_k": OP9_SQL}
