"""Dates by tables of elapsed time against dates by steps from the middle."""

import random

from pyspark.sql import functions as F

from tactuslab.functions import kernels
from tactuslab.operators import ticks

ARGS = ("s", "e", "bpm", "beat", "t", "m")


def test_same_dates(spark):
    r = random.Random(8)
    rows = []
    for k in range(1500):
        s = 720 * r.randint(0, 9)
        rows.append((k, float(s), float(s + 720 * r.randint(1, 40)), r.uniform(30, 160), r.choice([0.25, 0.5]), r.choice([None, 0.0, r.uniform(30, 160)]), r.choice([None, r.uniform(0.1, 0.9)]), r.uniform(-0.1, 1.2)))
    t = spark.createDataFrame(rows, "k int, s double, e double, bpm double, beat double, t double, m double, share double")
    args = [F.col(a) for a in ARGS]
    t = t.withColumn("table", kernels.elapsed_table(*args)).withColumn("ms", F.col("share") * kernels.ms_at(F.col("e"), *args))
    t = t.select("*", kernels.date_at(F.col("ms"), *args, steps=30).alias("plain"), kernels.date_at(F.col("ms"), *args, table=F.col("table")).alias("by_table"))
    out = t.collect()
    assert sum(x["table"] is not None for x in out) > 300 and all(len(x["table"]) == kernels.MARKS + 1 for x in out if x["table"])
    far = [x for x in out if abs(x["plain"] - x["by_table"]) > 1e-9]
    assert all(abs(x["plain"] - x["by_table"]) <= 1 for x in far) and len(far) <= 3


def test_frames_carry_tables_to_notes(spark):
    """Notes under transitions: each one's tick date is the date at which its tempo has come to its onset."""
    tempos = spark.createDataFrame([(1, None, "a", 0.0, 60.0, 0.25, 120.0, 0.4), (1, None, "b", 5760.0, 120.0, 0.25, None, None), (1, None, "c", 8640.0, 90.0, 0.25, 45.0, 0.7)], "perf_id long, scope int, id string, date double, bpm double, beat_length double, transition_to double, mean_tempo_at double")
    notes = spark.createDataFrame([(1, f"n{k}", k, 1, k * 360, 360, 60, 0.31 * k, 0.2, 60.0) for k in range(40)], "perf_id long, note_id string, seq long, part int, date long, duration long, midi_pitch int, onset double, midi_duration double, velocity double")
    frames = ticks.frames(tempos, notes)
    assert [len(x["elapsed"] or ()) for x in frames.orderBy("date").collect()] == [17, 0, 17]
    got = ticks.tick_onsets(notes, tempos, frames)
    rows = got.join(frames.select("perf_id", F.col("date").alias("s"), "end_date", "bpm", "beat_length", "transition_to", "mean_tempo_at", "begin_ms"), "perf_id").where("date >= s AND date < end_date")
    tempo = [F.col(c) for c in ("s", "end_date", "bpm", "beat_length", "transition_to", "mean_tempo_at")]
    rows = rows.select("note_id", "tick_date", (F.col("onset") * 1000 - F.col("begin_ms")).alias("want"), kernels.ms_at(F.col("tick_date"), *tempo).alias("ms"), "s", "end_date")
    out = [x for x in rows.collect() if x["s"] < x["tick_date"] < x["end_date"]]
    assert len(out) > 15 and all(abs(x["ms"] - x["want"]) < 1.0 for x in out)
