"""A corpus pipeline: five stages of the llm operators over documents, each written as Parquet and read by the next.

Every stage works on all that its predecessor kept. The first four return the columns of documents; the last returns
the packed pieces of what is left. A decision on a row holds for the rows of the same doc_id and text and for no others:
of two rows with one doc_id but different texts, one may go and the other stay, and a row with a null doc_id is decided
on by its text. Null, empty and blank texts pass the first four stages unchanged (only a text that line dedup empties
goes), and are packed as one token each. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from listingops.llm.common import if_small, table, written
from listingops.llm.queries import CAPACITY, END_ID, vocabulary


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text are those of rows(doc_id, text_key), a written table."""
    gone = if_small(rows.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_k")), "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects; rejected documents go.

    Null and empty texts weigh 0 and are drawn like others. Repeated rows are selected or rejected together. Without
    labels of both kinds every row stays.
    """
    chosen = quality.resample(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _without(docs, written(chosen.filter(~F.col("selected")).select("doc_id", "text_key").distinct(), "rejected"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; documents of which nothing is left go. n_chars follows the text.

    Rows with a null text or doc_id stay as they are; repeated rows of one doc_id and text are cleaned alike.
    """
    cleaned = line_dedup.dedup_lines(docs).filter("deleted_lines IS NULL OR text <> ''")
    return cleaned.withColumn("n_chars", F.when(F.col("deleted_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least doc_id (nulls last), then the least text key.

    Of rows repeated in doc_id and text one stays, an arbitrary one if other columns differ. Texts without words are in
    no group and stay.
    """
    joined = written(jaccard_join.near_duplicates(docs, 5, 80, 100).filter("n_shingles > 0").groupBy("component_key", "doc_id", "text_key").count(), "groups")
    first = joined.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first"))
    named = joined.join(first, "component_key")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    left = _without(docs, written(named.filter(~kept).select("doc_id", "text_key"), "gone"))
    repeated = written(named.filter(kept & (F.col("count") > 1)).select("doc_id", "text_key"), "repeated")
    if repeated.isEmpty():
        return left
    some = if_small(repeated.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")))
    once = left.join(some, left["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(left["text"]) == F.col("_k")), "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(left, repeated).unionByName(once.select(*docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts hold none and stay."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, written(leaks.select("doc_id", "text_key").distinct(), "leaks"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences of at most 1024. Every row is packed, repeated ones each."""
    return packing.pack_documents(docs, vocabulary(), CAPACITY, END_ID)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
