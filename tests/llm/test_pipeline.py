import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, text_key long, count int"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_run_in_order_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] > 0.5 * left[0]
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == left[-1]
    assert packed.exceptAll(corpus_pipeline.run(spark, SF)).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t or ""), "k", 1, 2) for d, t in rows], SCHEMA)


def kept(spark, name, rows):
    out = STAGES[name](spark, rows_of(spark, rows), SF)
    assert out.columns == rows_of(spark, []).columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


@pytest.fixture(scope="module")
def item(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").filter("text IS NOT NULL").orderBy(F.length("text").desc()).first().text


def prose(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice("alder birch cedar dogwood elm fir ginkgo hazel ivy juniper larch maple".split()) + str(r.randrange(99)) for _ in range(n))


def test_stages_of_an_empty_table_and_of_texts_without_words(spark):
    blank = [(1, None), (2, ""), (3, " \n "), (None, None), (None, "")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, rows_of(spark, []), SF)
        assert none.count() == 0 and none.columns == rows_of(spark, []).columns, name
        if name != "quality classifier":  # it draws a share of the rows
            assert kept(spark, name, blank) == sorted(blank, key=str), name
    assert STAGES["best-fit packing"](spark, rows_of(spark, []), SF).count() == 0
    packed = STAGES["best-fit packing"](spark, rows_of(spark, blank), SF).collect()
    assert len(packed) == 5 and sorted(p.length for p in packed)[:4] == [1, 1, 1, 1]


def test_duplicates_by_row(spark):
    """Ids that repeat with other texts stay, repeated rows go but for one, null ids take part by their text."""
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a), (1, b), (2, a), (5, c), (5, c), (None, b), (None, prose(4)), (None, prose(4)), (7, "")]
    assert kept(spark, "n-gram Jaccard join", rows) == sorted([(1, a), (1, b), (5, c), (None, prose(4)), (7, "")], key=str)


def test_leaks_by_row(spark, item):
    clean, leak = prose(5), prose(6, 9) + " " + item + " " + prose(7, 9)
    rows = [(1, clean), (1, leak), (None, leak), (None, clean), (2, leak)]
    assert kept(spark, "benchmark decontamination", rows) == sorted([(1, clean), (None, clean)], key=str)


def test_quality_by_row(spark, monkeypatch):
    """Only the rejected row goes where ids repeat or are null."""
    rows = [(1, prose(8)), (1, prose(9)), (None, prose(10)), (None, prose(11))]
    bad = {prose(9), prose(11)}

    def resample(docs, labels):
        return docs.select("doc_id", F.xxhash64("text").alias("text_key"), (~F.col("text").isin(bad)).alias("selected"))

    monkeypatch.setattr(corpus_pipeline.quality, "resample", resample)
    assert kept(spark, "quality classifier", rows) == sorted([(1, prose(8)), (None, prose(10))], key=str)


def test_quality_keeps_all_without_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None), (2, prose(12)), (2, prose(12)), (None, "x")]
    assert STAGES["quality classifier"](spark, rows_of(spark, rows), str(tmp_path)).count() == 4
