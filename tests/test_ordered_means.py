"""Means are those of a sum in the order of notes, however rows are spread over partitions."""

import random

import pytest
from pyspark.sql import functions as F

from tactuslab.operators import articulation, ornaments, relops, rubato
from tactuslab.operators import notes as ops


@pytest.fixture(scope="module")
def played(spark):
    r = random.Random(4)
    rows = [(p, str(k), k, 60, 360 * (k % 7), 360 * r.randint(1, 4), 720 * r.randint(1, 9) / 8, float(r.randint(1, 127)), 3.0) for p in range(60) for k in range(40)]
    columns = ("perf_id", "note_id", "seq", "midi_pitch", "date", "duration", "tick_duration", "velocity", "abs_vel_change")
    df = spark.createDataFrame(rows, "perf_id long, note_id string, seq long, midi_pitch int, date long, duration long, tick_duration double, velocity double, abs_vel_change double")
    return [dict(zip(columns, x, strict=True)) for x in rows], df.repartition(13, "seq").sortWithinPartitions(F.rand(3))


def folded(rows, value):
    sums = {}
    for x in rows:
        s, n = sums.get(x["perf_id"], (0.0, 0))
        sums[x["perf_id"]] = s + value(x), n + 1
    return {p: s / n for p, (s, n) in sums.items()}


def test_definition(played):
    rows, df = played
    got = articulation.definition(articulation.values(df), articulation.ASPECTS).collect()
    assert {x.perf_id: x.rel_dur for x in got} == folded(rows, lambda x: x["tick_duration"] / x["duration"])
    assert {x.perf_id: x.rel_vel for x in got} == folded(rows, lambda x: (x["velocity"] + 3) / x["velocity"])


def test_undone(played):
    rows, df = played
    chosen = articulation.values(df)
    mean = folded(rows, lambda x: x["tick_duration"] / x["duration"])
    got = articulation.undone(df, chosen, articulation.definition(chosen, ("rel_dur",))).select("perf_id", "seq", "tick_duration").collect()
    assert {(x.perf_id, x.seq): x.tick_duration for x in got} == {(x["perf_id"], x["seq"]): x["tick_duration"] / mean[x["perf_id"]] for x in rows}


def test_default_articulation(spark, played):
    rows, df = played
    none = spark.createDataFrame([], "perf_id long, date long, noteid array<string>")
    mean, _ = ops.make_default_articulation(df, none)
    assert {x.perf_id: x.rel_dur for x in mean.collect()} == folded(rows, lambda x: x["tick_duration"] / x["duration"])


def test_late_start(played):
    """A rubato's late start is the mean place of the notes on its first date: one date here, of 40 notes."""
    rows, df = played
    df = df.withColumn("date", F.lit(0)).withColumn("part", F.lit(1)).withColumn("tick_date", F.col("tick_duration") / F.col("duration") * 10)
    got = rubato.insert_rubato(df, 0, 720).collect()
    assert {x.perf_id: x.late_start for x in got} == {p: m / 720 for p, m in folded(rows, lambda x: x["tick_duration"] / x["duration"] * 10).items()}


def test_chords(played):
    """The mean onset of a chord of many notes, as chords have it and as an arpeggio is placed."""
    rows, df = played
    df = df.withColumn("date", F.lit(0)).withColumn("onset", F.col("tick_duration") / F.col("duration")).withColumn("midi_duration", F.lit(1.0))
    want = folded(rows, lambda x: x["tick_duration"] / x["duration"])
    assert {x.perf_id: x.mean_onset for x in relops.chords(df).collect()} == want
    assert {x.perf_id: x["mean"] for x in ornaments.spread_chords(df, with_intensity=False).collect()} == want


def test_asynchrony(played):
    rows, df = played
    onset = F.when(F.col("part") == 2, F.col("tick_duration") / F.col("duration")).otherwise(F.lit(0.0))
    df = df.withColumn("date", F.col("seq")).withColumn("part", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("onset", onset)
    shift, _ = ops.asynchrony(df, 1, 0, 100)
    assert {x.perf_id: x.shift for x in shift.collect()} == folded(rows, lambda x: x["tick_duration"] / x["duration"])
