"""Each stage of the pipeline on odd rows, on an empty table, and with columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHING = ("__kept", "__rejected_by", "__judged", "__n_lines", "__th", "__row", "__gone", "component_id", "item_id", "length", "__x")


@pytest.fixture(scope="module")
def odd(spark, corpus, tmp_path_factory):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus]
    rows += rows[:3] + [(None, corpus[0][1], None, None, None), (None, None, None, None, None), (9000, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        df = df.withColumn(name, F.lit(1))
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stage(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    kept = out.count()
    assert 0 < kept <= odd.count() and (kept == odd.count()) == (name in ("line_dedup", "decontamination"))
    assert out.filter("doc_id is null and text is not null").count() == 1  # a text like any other
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, odd):
    out = corpus_pipeline.near(spark, odd, SF)
    assert out.filter("doc_id = 1").count() == 2 and out.filter("doc_id is null").count() == 2  # repeated rows go or stay together
    exact = odd.filter("doc_id is not null and text is not null and length(trim(text)) > 20").groupBy("text").agg(F.min("doc_id").alias("first"))
    assert out.join(exact, "text").filter("doc_id <> first").count() == 0


def test_last_stage(spark, odd):
    out = corpus_pipeline.pack(spark, odd, SF)
    assert out.filter("start = 0").count() == odd.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    assert corpus_pipeline.pack(spark, odd.limit(0), SF).count() == 0
