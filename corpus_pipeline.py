"""The corpus pipeline: documents through five operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from tactuslab.llm.common import discard, saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; labels of documents that are no longer there aren't used."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs; n_chars is that of the new text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    n = F.when(F.size("deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id, once.

    Rows are told apart by doc_id, null or not, and text. Of rows equal in both one stays, unless they
    have no words; two texts under the smallest doc_id both stay.
    """
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), with_hash=True)
    found = found.groupBy("doc_id", "text_hash").agg(F.bool_and("kept").alias("kept"), ((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("again"))
    found = saved(found.where("NOT kept OR again").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "kept"), "repeated")
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h"))
    rest = docs.join(found, same, "left_anti").select(*COLUMNS)
    once = docs.join(found.where("kept"), same, "left_semi").groupBy("doc_id", "text_hash").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return rest.unionByName(once.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", delete_repeated_lines),
    ("near dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores, clusters and tokens can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again for the next, which then removes it."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before, made = made, saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        docs = made
        if before is not None:
            discard(before)
    return docs
