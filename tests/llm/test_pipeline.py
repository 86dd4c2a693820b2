import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tactuslab.llm import line_dedup, near_dedup

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_take_effect_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).persist()
        kept[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    before, after = kept["line dedup"]
    assert before.count() == after.count()
    assert line_dedup.dedup_lines(after).where(F.size("deleted") > 0).count() == 0
    before, after = kept["near dedup"]
    assert near_dedup.near_duplicates(before).where("kept").count() == after.count()
    before, after = kept["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words that are only here", None, "s", 29), (4, "same " * 60, "en", None, 300), (5, "same " * 60, "en", "s", 300), (5, "same " * 60, "en", "s", 300)]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words that are only here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == [1, 2, 4, 5, 5]
