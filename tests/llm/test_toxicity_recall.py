"""What the toxicity model finds among rows that it hasn't learned from, over whole tables."""

import pytest
from pyspark.sql import functions as F

from tactuslab.llm import queries


@pytest.mark.parametrize(("sf", "recall", "false_alarms"), [("sf0.1", 0.9, 0.02), ("sf0.01", 0.6, 0.02)])
def test_held_out_recall(spark, sf, recall, false_alarms):
    sf_dir = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = queries.op3_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in rows}
    assert share[1] >= recall and share[0] <= false_alarms
