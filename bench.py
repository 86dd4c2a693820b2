"""Times headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.operators import dynamics, ornaments, tempo
from tactuslab.queries import QUERIES
from tactuslab.sources import derived

HEADLINE = (
    "ioi_tempo", "chords", "make_choice_default", "spread_detect", "spread_intensity", "gradient_sorted", "wls_init", "tick_onset_frames", "tick_duration_frames",
    "ornament_ms_to_ticks", "elapsed_ms", "ms_at_simpson", "volume_at_date", "rubato_on_date", "accent_pattern", "articulation_undo", "articulation_conflicts", "dbscan_2d", "asynchrony_apply", "tempo_fit",
)


def large_ioi_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.tempo_points(tempo.onset_pairs(derived.bench_notes(spark, sf_dir)))


def large_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ornaments.spread_chords(derived.bench_notes(spark, sf_dir), with_intensity=False).drop("onsets")


def large_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.bench_notes(spark, sf_dir)
    return dynamics.residual(n, dynamics.two_point(dynamics.points(n, start=0, end=36000)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["notes_scan"](spark, sf_dir).agg(F.count("*")).collect()  # starts the engine
    took = {}
    runs = {n: QUERIES[n] for n in HEADLINE} | {f.__name__: f for f in (large_ioi_tempo, large_spread, large_dynamics)}
    for name, f in runs.items():
        began = time.perf_counter()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
