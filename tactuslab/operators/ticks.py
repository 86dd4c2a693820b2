"""From physical time to score time: frames of tempos anchored at heard onsets, and what falls into them.

Whoever needs more than one of these makes the frames once, writes them, and passes them as made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.functions.kernels import MARKS, date_at, elapsed_at, elapsed_table
from tactuslab.operators import relops

TEMPO = ["date", "end_date", "bpm", "beat_length", "transition_to", "mean_tempo_at"]
#: What a frame hands to the rows that fall into it: its tempo, and its elapsed time at some of its dates.
FRAME = [*TEMPO, "elapsed"]


def frames(tempos: DataFrame, notes: DataFrame) -> DataFrame:
    """Tempos with end_date and begin_ms: the model's running time, set anew to the first note's onset wherever one stands on a frame's start."""
    rows = relops.with_end(tempos, relops.ends(notes))
    rows = rows.withColumn("elapsed", elapsed_table(*[F.col(c) for c in TEMPO]))
    rows = rows.withColumn("length_ms", F.coalesce(F.get("elapsed", F.lit(MARKS)), elapsed_at(F.col("end_date"), *[F.col(c) for c in TEMPO])))
    heads = notes.groupBy("perf_id", F.col("date").cast("double").alias("date")).agg((F.min_by("onset", "seq") * 1000).alias("anchor"))
    rows = rows.join(heads, ["perf_id", "date"], "left").withColumn("anchor", F.when(F.col("frame") > 1, F.col("anchor")))
    rows = relops.running_with_resets(rows, "length_ms", "anchor", "frame", "begin_ms")
    # Up to the next frame's beginning as it was heard, where one was.
    ahead = F.lead("anchor").over(Window.partitionBy("perf_id").orderBy("frame"))
    last = notes.join(rows.where("is_last").select("perf_id", F.col("end_date").alias("_e")), "perf_id").where("date = _e").groupBy("perf_id").agg((F.min_by("onset", "seq") * 1000).alias("_last"))
    rows = rows.join(last, "perf_id", "left").withColumn("heard_ms", F.coalesce(F.when(F.col("is_last"), F.col("_last")).otherwise(ahead) - F.col("begin_ms"), F.col("length_ms")))
    return rows.drop("_last", "anchor")


def _date(ms, prefix: str = ""):
    return date_at(ms, *[F.col(prefix + c) for c in TEMPO], table=F.col(prefix + "elapsed"))


def tick_onsets(notes: DataFrame, tempos: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """notes with tick_date: where the tempo in force at their score date puts their onset. Before the first tempo there is none."""
    f = frames(tempos, notes) if made is None else made
    rows = relops.asof(notes, f, [*FRAME, "begin_ms"], prefix="_t_")
    # At a quarter a second from time 0 seconds are quarters: on the way through milliseconds a last digit may go.
    plain = (F.col("_t_begin_ms") == 0) & (F.col("_t_bpm") * F.col("_t_beat_length") * 4 == 60) & F.coalesce(F.col("_t_transition_to") == 0, F.lit(True))
    at = F.when(plain, F.col("_t_date") + F.col("onset") * 720).when(F.col("_t_bpm").isNotNull(), _date(F.col("onset") * 1000 - F.col("_t_begin_ms"), "_t_"))
    return rows.withColumn("tick_date", at).select(*notes.columns, *([] if "tick_date" in notes.columns else ["tick_date"]))


def tick_durations(notes: DataFrame, tempos: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """notes (with tick_date) with tick_duration: the last frame in which a note's end is heard, both ends counted, gives it; past the last there is none."""
    f = (frames(tempos, notes) if made is None else made).select("perf_id", "frame", *[F.col(c).alias(f"_t_{c}") for c in FRAME], "begin_ms", "heard_ms")
    ended = notes.where(F.col("midi_duration").isNotNull() & (F.col("midi_duration") != 0)).withColumn("_end", (F.col("onset") + F.col("midi_duration")) * 1000)
    # Frames follow each other, so the last that begins at or before the end, or one that ends just there, is the one.
    cand = _asof_ms(ended, f)
    inside = F.col("_end") - F.col("begin_ms") <= F.col("heard_ms")
    value = F.when(inside, _date(F.col("_end") - F.col("begin_ms"), "_t_") - F.col("tick_date"))
    out = cand.select("perf_id", "seq", "note_id", value.alias("_d"))
    rows = notes.drop("tick_duration").join(out, ["perf_id", "seq", "note_id"], "left").withColumn("tick_duration", F.col("_d")).drop("_d")
    return rows


def _asof_ms(rows: DataFrame, f: DataFrame) -> DataFrame:
    right = f.withColumn("_begin", F.col("begin_ms")).withColumnRenamed("begin_ms", "_b")
    left = rows.withColumnRenamed("date", "_date").withColumn("date", F.col("_end"))
    right = right.withColumn("date", F.col("_begin"))
    out = relops.asof(left, right, ["frame", "_b", "heard_ms", *[f"_t_{c}" for c in FRAME]], at="date")
    return out.drop("date").withColumnsRenamed({"_date": "date", "_b": "begin_ms"})


def pedal_ticks(pedals: DataFrame, notes: DataFrame, tempos: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """pedals with tick_date and tick_duration, from the frames in which their beginning and their end are heard (half open)."""
    f = (frames(tempos, notes) if made is None else made).select("perf_id", "frame", *[F.col(c).alias(f"_t_{c}") for c in FRAME], "begin_ms", "length_ms", "heard_ms")
    out = pedals.drop("tick_date", "tick_duration")
    for name, at, span in (("tick_date", F.col("onset"), "length_ms"), ("_tick_end", F.col("onset") + F.col("midi_duration"), "heard_ms")):
        right = f.withColumn("_b", F.col("begin_ms")).withColumn("date", F.col("begin_ms"))
        rows = _asof_at(out.withColumn("_end", at * 1000), right, span)
        inside = F.col("_end") - F.col("_b") < F.col(span)
        out = rows.withColumn(name, F.when(inside, _date(F.col("_end") - F.col("_b"), "_t_"))).select(*out.columns, name)
    return out.withColumn("tick_duration", F.col("_tick_end") - F.col("tick_date")).drop("_tick_end")


def _asof_at(rows: DataFrame, right: DataFrame, span: str) -> DataFrame:
    left = rows.withColumnRenamed("date", "_date") if "date" in rows.columns else rows
    out = relops.asof(left.withColumn("date", F.col("_end")), right, ["_b", span, *[f"_t_{c}" for c in FRAME]], at="date").drop("date")
    return out.withColumnRenamed("_date", "date") if "_date" in out.columns else out


def ornament_ticks(ornaments: DataFrame, notes: DataFrame, tempos: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """Ornament frames in milliseconds as ticks: the ornament's own time, then its frame's start and end, through the tempo frames."""
    f = frames(tempos, notes) if made is None else made
    done = ornaments.where(F.col("time_unit").eqNullSafe("ticks"))
    rows = ornaments.where(~F.col("time_unit").eqNullSafe("ticks"))
    rows = relops.asof(rows, f, [*FRAME, "begin_ms"], prefix="_t_")
    own = F.col("_t_begin_ms") + elapsed_at(F.col("date").cast("double"), *[F.col(f"_t_{c}") for c in TEMPO])
    rows = rows.withColumn("_s", own + F.col("frame_start")).withColumn("_e", F.col("_s") + F.col("frame_length")).drop(*[f"_t_{c}" for c in [*FRAME, "begin_ms"]])
    right = f.select("perf_id", "frame", *[F.col(c).alias(f"_t_{c}") for c in FRAME], F.col("begin_ms").alias("_b"), F.col("begin_ms").alias("date"), "length_ms")
    for name in ("_s", "_e"):
        base = rows.columns
        found = _asof_at(rows.withColumn("_end", F.col(name)), right, "length_ms")
        inside = F.col(name) - F.col("_b") < F.col("length_ms")
        rows = found.withColumn(f"{name}_ticks", F.when(inside, _date(F.col(name) - F.col("_b"), "_t_"))).select(*base, f"{name}_ticks")
    rows = rows.withColumn("frame_start", F.col("_s_ticks") - F.col("date")).withColumn("frame_length", F.col("_e_ticks") - F.col("_s_ticks")).withColumn("time_unit", F.lit("ticks"))
    return rows.select(*ornaments.columns).unionByName(done)
