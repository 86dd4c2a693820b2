"""Performances derived from general event tables: a user is a performance, an event a note.

Half a day is one beat and one second, so the nominal tempo is 60 beats a minute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.model import State

HALF_DAY_US = 43_200_000_000


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", us.alias("us"))


def notes(spark: SparkSession, sf_dir: str, pitches: int = 37, fixed_duration: bool = False) -> DataFrame:
    """Notes of all performances; with few pitches and one duration they hold many takes of a note."""
    e = events(spark, sf_dir)
    duration = F.lit(720) if fixed_duration else 360 * (1 + F.col("event_id") % 4)
    return e.select(
        F.col("user_id").alias("perf_id"),
        F.col("event_id").alias("note_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("view", "click"), 1).otherwise(2).alias("part"),
        (F.expr(f"us div {HALF_DAY_US}") * 720).cast("long").alias("date"),
        duration.cast("long").alias("duration"),
        (F.col("us") / F.lit(float(HALF_DAY_US))).alias("onset"),
        (0.25 + (F.col("event_id") % 8) * 0.125).alias("midi_duration"),
        (48 + F.col("event_id") % pitches).cast("int").alias("midi_pitch"),
        F.least(F.lit(127.0), 1 + F.floor("value").cast("double")).alias("velocity"),
        F.col("event_type").alias("source"),
    )


def pedals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    return e.select(
        F.col("user_id").alias("perf_id"),
        F.col("event_id").alias("pedal_id"),
        F.when(F.col("event_type") == "error", "sustain").otherwise("soft").alias("type"),
        (F.col("us") / F.lit(float(HALF_DAY_US))).alias("onset"),
        (0.25 + (F.col("event_id") % 8) * 0.125).alias("midi_duration"),
        F.col("event_type").alias("source"),
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("perf_id")).distinct().select("perf_id", F.lit(4).alias("ts_numerator"), F.lit(4).alias("ts_denominator"))


def constant_tempo(spark: SparkSession, sf_dir: str, bpm: float = 60.0) -> DataFrame:
    """One tempo from date 0 on in each performance."""
    return meta(spark, sf_dir).select("perf_id", F.lit(None).cast("int").alias("scope"), F.lit("tempo_0").alias("id"), F.lit(0.0).alias("date"), F.lit(bpm).alias("bpm"), F.lit(0.25).alias("beat_length"), F.lit(None).cast("double").alias("transition_to"), F.lit(None).cast("double").alias("mean_tempo_at"))


def bench_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many more notes: a supplier is a performance, a line item a note, 30 days a chord."""
    days = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1992-01-01 00:00:00', l_shipdate)")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("perf_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("note_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (1 + F.col("l_linenumber") % 2).cast("int").alias("part"),
        (F.floor(days / 30) * 720).cast("long").alias("date"),
        (360 * (1 + F.col("l_linenumber") % 4)).cast("long").alias("duration"),
        (days / 30.0).alias("onset"),
        (0.25 + F.col("l_discount")).alias("midi_duration"),
        (48 + F.col("l_partkey") % 37).cast("int").alias("midi_pitch"),
        F.least(F.lit(127.0), F.col("l_quantity").cast("double")).alias("velocity"),
        F.col("l_returnflag").alias("source"),
    )


def state(spark: SparkSession, sf_dir: str) -> State:
    """The derived performances as the chain's input."""
    n = notes(spark, sf_dir).withColumn("note_id", F.col("note_id").cast("string"))
    for c in ("tick_date", "tick_duration", "abs_vel_change"):
        n = n.withColumn(c, F.lit(None).cast("double"))
    p = pedals(spark, sf_dir).withColumn("pedal_id", F.col("pedal_id").cast("string"))
    p = p.withColumn("tick_date", F.lit(None).cast("double")).withColumn("tick_duration", F.lit(None).cast("double"))
    return State(n, p, meta(spark, sf_dir), {"tempo": constant_tempo(spark, sf_dir)})
