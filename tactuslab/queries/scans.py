"""One performance of any length: as-of lookups, sums and resets that spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.operators import scan
from tactuslab.queries.base import query


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as the notes of one performance, an order a date."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(F.lit(1).alias("perf_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("note_id"), F.col("l_orderkey").alias("date"), F.col("l_quantity").cast("long").alias("quantity"))


@query("""SELECT l_orderkey * 8 + l_linenumber AS note_id, o.o_orderkey AS tempo_date, o.o_custkey AS bpm FROM lineitem l
  ASOF LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 5 = 0) o ON l.l_orderkey >= o.o_orderkey""")
def asof_one_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tempo in force at each note of one performance."""
    tempos = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 5 = 0")
    tempos = tempos.select(F.lit(1).alias("perf_id"), F.col("o_orderkey").alias("date"), F.col("o_orderkey").alias("tempo_date"), F.col("o_custkey").alias("bpm"))
    return scan.asof(_one(spark, sf_dir), tempos, ["tempo_date", "bpm"]).select("note_id", "tempo_date", "bpm")


@query("""SELECT o_orderkey AS frame, coalesce(base, 0) + coalesce(sum(step) OVER (PARTITION BY island ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_ms FROM (
  SELECT *, first_value(anchor) OVER (PARTITION BY island ORDER BY o_orderkey) AS base FROM (
    SELECT *, count(anchor) OVER (ORDER BY o_orderkey) AS island FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS step, CASE WHEN o_custkey % 40 = 0 THEN o_custkey::DOUBLE END AS anchor FROM orders)))""")
def resets_one_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running time of one performance's frames, set anew wherever one is anchored."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    frames = orders.select(F.lit(1).alias("perf_id"), F.col("o_orderkey").alias("frame"), F.floor("o_totalprice").cast("double").alias("step"), F.when(F.col("o_custkey") % 40 == 0, F.col("o_custkey").cast("double")).alias("anchor"))
    return scan.running_with_resets(frames, "step", "anchor", "frame", "begin_ms").select("frame", "begin_ms")


@query("SELECT o_orderkey AS note_id, (sum(floor(o_totalprice)::BIGINT) OVER w)::BIGINT AS total, row_number() OVER w AS place FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def sums_one_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum and number of each note of one performance."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(1).alias("perf_id"), F.col("o_orderkey").alias("note_id"), F.floor("o_totalprice").alias("price"))
    rows = scan.running(orders, ["note_id"], {"total": "price", "place": F.lit(1).cast("long")}, ["perf_id"])
    return rows.select("note_id", "total", "place")
