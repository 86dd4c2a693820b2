"""Connected components over edges that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactuslab.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node it reaches, for the nodes of edges (a, b).

    Every node takes the smallest label beside it, then the label of its label, until none changes;
    the steps grow as the logarithm of the longest path. Each step is written to the shared folder.
    Edges may repeat, loop, or be none; those with a null end are left out. A hub's edges meet its label
    in a join of two written tables, which adaptive execution splits; minima are taken in part before
    they are dealt out. The result is a written table, which its user may discard.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        out = step.join(jump, "next", "left").select("node", F.least("next", "far").alias("to"), "label")
        before, labels = labels, saved(out.select("node", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved")), "labels")
        discard(before)
    discard(both)
    out = labels.select("node", "label")
    out._saved_at = labels._saved_at
    return out
