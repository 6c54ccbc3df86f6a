"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from listingops.llm import decontaminate, jaccard_join, license_scan, line_dedup, packing, quality, secrets_scan, sharding, topk_search, toxicity
from listingops.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, key string, size int, score string, n int, shard int, rank int, selected int, cid long"
LONG = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce. " * 4000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "one two"), (5, "one two"), (None, "a text without an id here"), (6, "one two"), (7, "naïve ÉCOLE \U0001f600 password=abcdefghijkl123")]
    return spark.createDataFrame([(d, t, "k", 1, "s", 2, 3, 4, 5, 6) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_each_row_comes_back(spark, docs, empty):
    toxic = labels(spark).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, toxic)
    secrets = secrets_scan.Model(secrets_scan.np.zeros((secrets_scan.EDGE + 1, secrets_scan.EDGE + 1)))
    for f in (
        lambda d: secrets_scan.scan(d, secrets),
        lambda d: sharding.shard_documents(d, 3),
        lambda d: toxicity.score(d, model),
        lambda d: quality.resample(d, labels(spark)),
        line_dedup.dedup_lines,
        jaccard_join.near_duplicates,
    ):
        assert f(docs).count() == 9
        assert f(empty).count() == 0


def test_jaccard_without_an_id(spark, docs):
    one = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d  e f"), (4, "x y"), (None, "x Y"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(one).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 2, None), (4, 1, 4), (None, 1, 4), (None, 0, None)], key=str)


def test_scans_of_nothing(spark, docs, empty):
    assert decontaminate.find_leaks(empty, bench(spark)).count() == 0
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert {r.doc_id for r in decontaminate.find_leaks(docs, bench(spark)).collect()} == {5, 6}
    assert license_scan.scan_licenses(docs).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert secrets_scan.fit(empty) is not None


def test_packing_edges(docs, empty):
    rows = packing.pack_documents(docs, vocabulary(), 64).collect()
    assert packing.pack_documents(empty, vocabulary(), 64).count() == 0
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]


def test_shards_without_rows_of_a_kind(spark):
    one = spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")
    out = sharding.shard_documents(one, 8).collect()
    assert len({r.shard for r in out}) == 1 and sorted(r.slot for r in out) == list(range(50))


def test_search_edges(spark):
    rows = [(0, [1, 2]), (100, None), (3, [1, None]), (4, [1, 2, 3]), (5, [1, 2]), (5, [1, 2]), (None, [9, 9]), (6, [0, 0])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    out = topk_search.exact_top_k(v, v.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id"), 10).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(out)] == [(1, 5, 5), (2, 5, 5), (3, 6, 0)]
    none = v.limit(0)
    assert topk_search.exact_top_k(none, none.withColumnRenamed("vec_id", "query_id"), 10).count() == 0


def test_quality_without_labels_keeps_all(spark, docs):
    none = labels(spark).limit(0)
    assert quality.resample(docs, none).filter("NOT selected").count() == 0
