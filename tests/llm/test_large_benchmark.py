"""A benchmark beyond what tasks get as an index: the join of tables gives the same rows, in as many passes at any size."""

from pyspark.sql import functions as F

from tactuslab.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_both_ways_agree_on_whole_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda chars: sorted(repr(tuple(r)) for r in decontaminate.find_contamination(docs, items, block_chars=chars).drop("text").collect())
    index = rows(1 << 30)
    assert index == rows(0) and any("], ['" in r for r in index)


def test_passes_do_not_grow_with_the_benchmark(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it all"
    docs = spark.createDataFrame([(k, f"{k} {text} {k}") for k in range(50)], "doc_id long, text string").repartition(2)

    def passes(copies):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        read = docs.mapInArrow(count, docs.schema)
        items = spark.range(copies).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.lit(text), F.col("id").cast("string")).alias("text"))
        found = decontaminate.digest(decontaminate.find_contamination(read, items, block_chars=100)).collect()
        # Document k has all words of the sentence; item k's last window, with the number behind it, stands in it too.
        assert all(r["n_items"] == copies and r["n_hit"] == len(text.split()) + (r["doc_id"] < copies) for r in found)
        return seen.value / 50

    assert passes(2) == passes(200) == 4


def test_a_shingle_that_every_window_and_text_has(spark):
    docs = spark.createDataFrame([(k, f"which of the following is {k % 7}") for k in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"which of the following is {k}") for k in range(300)], "item_id long, text string")
    found = decontaminate.find_contamination(docs, items, block_chars=0).collect()
    assert len(found) == 300 and all(r["items"] == [str(r["doc_id"] % 7)] and r["spans"] == [0, 6] for r in found)
