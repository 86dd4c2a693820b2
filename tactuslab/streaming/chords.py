"""Notes as they arrive: chords of a stream of events, closed by watermark.

An extra: performances are otherwise read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of events in a folder, as a stream."""
    ntz = EVENTS.replace("ts timestamp", "ts timestamp_ntz")
    return spark.readStream.schema(ntz).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_chords(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """For each performance and half-day window how many notes and their mean velocity; later notes than lateness are left out."""
    rows = events.withWatermark("ts", lateness)
    w = F.window("ts", "12 hours")
    out = rows.groupBy(F.col("user_id").alias("perf_id"), w.alias("w")).agg(F.count(F.lit(1)).alias("n_notes"), F.avg(F.least(F.lit(127.0), 1 + F.floor("value").cast("double"))).alias("mean_velocity"))
    return out.select("perf_id", F.col("w.start").alias("beat"), "n_notes", "mean_velocity")
