"""Arpeggios: temporal spread and dynamics gradient of chords, and styles clustered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.functions.kernels import spread_intensity
from tactuslab.model import by_performance, defined, in_scope
from tactuslab.operators import relops

OFFSET_SHARE = 0.8
MONOPHONIC_S = 0.02


def _dated(rows: DataFrame, date: int | Column | None) -> DataFrame:
    """Rows of one date; all without one."""
    if isinstance(date, Column):
        return rows.where(date.isNull() | (F.col("date") == date))
    return rows if date is None else rows.where(F.col("date") == date)


def spread_chords(notes: DataFrame, threshold_ms: float | None = 35.0, date: int | None = None, scope: int | None = None, with_intensity: bool = True) -> DataFrame:
    """Chords of two or more onsets that are spread: order of their notes, length, offset shift, intensity.

    A chord is a few notes at one date, so its onsets are gathered in order in one array. Equal onsets
    keep the order of the notes.
    """
    rows, at, scope = by_performance(notes.where(defined("onset")), date, scope)
    rows = _dated(rows.where(in_scope(scope)), at)
    chord = Window.partitionBy("perf_id", "date").orderBy("onset", "seq")
    rows = rows.withColumn("off", F.col("onset") + F.col("midi_duration")).withColumn("k", F.row_number().over(chord))
    rows = rows.withColumn("by_off", F.row_number().over(Window.partitionBy("perf_id", "date").orderBy("off", "k")))
    rows = rows.withColumn("dir", F.signum(F.col("midi_pitch") - F.lag("midi_pitch").over(chord))).withColumn("gap", F.abs(F.lag("off").over(chord) - F.col("onset")))
    c = rows.groupBy("perf_id", "date").agg(
        F.count(F.lit(1)).alias("n"), F.min("onset").alias("first"), F.max("onset").alias("last"), relops.mean_in_order(F.col("onset"), "seq").alias("mean"),
        F.min("dir").alias("lo"), F.max("dir").alias("hi"), F.bool_and(F.col("k") == F.col("by_off")).alias("same_order"),
        F.bool_and(F.coalesce(F.col("gap") <= MONOPHONIC_S, F.lit(True))).alias("mono"),
        F.min_by("off", "k").alias("first_off"), F.max_by("off", "k").alias("last_off"),
        F.array_sort(F.collect_list(F.struct("k", "onset", "note_id"))).alias("notes"),
    )
    length = F.col("last") - F.col("first")
    c = c.where("n > 1")
    c, at, threshold = by_performance(c, date, threshold_ms)
    if isinstance(at, Column) or isinstance(threshold, Column):
        c = c.where(F.lit(at).isNotNull() | F.lit(threshold).isNull() | (length * 1000 > threshold))
    elif at is None and threshold is not None:
        c = c.where(length * 1000 > threshold)
    ids = F.array_join(F.transform("notes", lambda x: F.concat(F.lit("#"), x.note_id.cast("string"))), " ")
    order = F.when((F.col("lo") == F.col("hi")) & (F.col("lo") == 1), "ascending pitch").when((F.col("lo") == F.col("hi")) & (F.col("lo") == -1), "descending pitch").otherwise(ids)
    shift = F.when(F.col("mono"), "monophonic").when(F.col("same_order") & (F.col("last_off") - F.col("first_off") > length * OFFSET_SHARE), "true").otherwise("false")
    out = c.select("perf_id", "date", "n", "first", "last", "mean", order.alias("note_order"), (length * 1000).alias("frame_length"), shift.alias("noteoff_shift"), F.transform("notes", lambda x: (x.onset - F.col("first")) / F.nullif(length, F.lit(0.0))).alias("onsets"))
    return out.withColumn("intensity", spread_intensity(F.col("onsets"))) if with_intensity else out


def temporal_spread(notes: DataFrame, placement: str = "estimate", threshold_ms: float | None = 35.0, date: int | None = None, scope: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ornaments in milliseconds for spread chords, and notes with all of a chord's onsets made one.

    placement: on-beat takes the first onset, before-beat the last, estimate the mean; none does nothing.
    """
    c, placement = by_performance(spread_chords(notes, threshold_ms, date, scope), placement)
    placed = lambda on, before, mean: F.when(F.lit(placement) == "on-beat", on).when(F.lit(placement) == "before-beat", before).otherwise(mean)
    c = c.where(F.coalesce(F.lit(placement) != "none", F.lit(True)))
    c = c.withColumn("frame_start", placed(F.lit(0.0), -F.col("frame_length"), (F.col("first") - F.col("mean")) * 1000)).withColumn("_new", placed(F.col("first"), F.col("last"), F.col("mean")))
    ornaments = c.select("perf_id", "date", F.lit("neutralArpeggio").alias("name_ref"), "note_order", "frame_start", "frame_length", F.lit("milliseconds").alias("time_unit"), "noteoff_shift", F.when(F.col("intensity") != 1, F.col("intensity")).alias("intensity"))
    moved, scope = by_performance(notes.join(c.select("perf_id", "date", "_new"), ["perf_id", "date"], "left"), scope)
    hit = F.col("_new").isNotNull() & defined("onset") & in_scope(scope)
    return ornaments, moved.withColumn("onset", F.when(hit, F.col("_new")).otherwise(F.col("onset"))).select(*notes.columns)


def sorted_velocities(notes: DataFrame, scope: int | None = None, wanted: bool = True) -> DataFrame:
    """The k-th note of a chord by onset gets its k-th velocity: rising if its loudest note comes after its quietest, else falling.

    Adds rises. Of equal velocities the first note counts; single notes fall. Performances that don't want it stay.
    """
    out_columns = notes.columns
    notes, scope, wanted = by_performance(notes, scope, wanted)
    own = in_scope(scope) & F.lit(wanted)
    by_onset = Window.partitionBy("perf_id", "date", "_own").orderBy("onset", "seq")
    chord = Window.partitionBy("perf_id", "date", "_own")
    rows = notes.withColumn("_own", own).withColumn("_k", F.row_number().over(by_onset))
    rows = rows.withColumn("rises", F.max_by("_k", F.struct("velocity", -F.col("_k"))).over(chord) > F.min_by("_k", F.struct("velocity", "_k")).over(chord))
    up = Window.partitionBy("perf_id", "date", "_own").orderBy("velocity", "_k")
    rows = rows.withColumn("_rank", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(chord))
    place = F.when(F.col("rises"), F.col("_rank")).otherwise(F.col("_n") + 1 - F.col("_rank"))
    ranked = rows.select("perf_id", "date", "_own", place.alias("_k"), F.col("velocity").alias("_v"))
    out = rows.join(ranked, ["perf_id", "date", "_own", "_k"])
    return out.withColumn("velocity", F.when(F.col("_own"), F.col("_v")).otherwise(F.col("velocity"))).select(*out_columns, "rises")


def dynamics_gradient(notes: DataFrame, gradient: tuple[float, float] | None = None, date: int | None = None, crescendo: tuple[float, float] = (-1.0, 0.0), decrescendo: tuple[float, float] = (0.0, -1.0), sort_velocities: bool = False, scope: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ornaments with the gradient from a chord's first velocity to its last, and notes at the standard velocity.

    Without a gradient a chord that ends louder than it begins is a crescendo, else a decrescendo; chords
    whose ends are equally loud, and dates without one, get none.
    """
    rows = notes if sort_velocities is False else sorted_velocities(notes, scope, sort_velocities).drop("rises")
    played, at, own = by_performance(rows.where(defined("onset")), date, scope)
    c = _dated(played.where(in_scope(own)), at).groupBy("perf_id", "date").agg(F.count(F.lit(1)).alias("n"), F.min_by("velocity", F.struct("onset", "seq")).alias("v0"), F.max_by("velocity", F.struct("onset", "seq")).alias("v1"))
    c = c.where(F.col("v0") != F.col("v1"))
    c, at, gradient, crescendo, decrescendo = by_performance(c, date, gradient, crescendo, decrescendo)
    c = c.where((F.col("n") > 1) | F.lit(at).isNotNull())
    rises = F.col("v1") > F.col("v0")

    def end(k: int) -> Column:
        pick = lambda pair: pair[("from", "to")[k]] if isinstance(pair, Column) else F.lit(None if pair is None else pair[k]).cast("double")
        return F.coalesce(pick(gradient), F.when(rises, pick(crescendo)).otherwise(pick(decrescendo)))

    start, to = end(0), end(1)
    c = c.withColumn("transition_from", start).withColumn("transition_to", to).withColumn("scale", (F.col("v1") - F.col("v0")) / F.nullif(F.col("transition_to") - F.col("transition_from"), F.lit(0.0)))
    c = c.where("scale IS NOT NULL").withColumn("standard", F.col("v0") - F.col("transition_from") * F.col("scale"))
    ornaments = c.select("perf_id", "date", F.lit("neutralArpeggio").alias("name_ref"), "transition_from", "transition_to", "scale", "standard")
    out, scope = by_performance(rows.join(c.select("perf_id", "date", "standard"), ["perf_id", "date"], "left"), scope)
    hit = F.col("standard").isNotNull() & defined("onset") & in_scope(scope)
    return ornaments, out.withColumn("velocity", F.when(hit, F.col("standard")).otherwise(F.col("velocity"))).select(*notes.columns)


def stylized(ornaments: DataFrame, tick_tolerance: float = 10.0, intensity_tolerance: float = 0.3, gradient_tolerance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Ornaments pointed to definitions, and these: clusters of frame, intensity and offset shift, then of gradients within each.

    Ornaments alone in either get a definition of their own; those without a frame keep what they have.
    """
    code = F.when(F.col("noteoff_shift") == "monophonic", -1.0).when(F.col("noteoff_shift") == "true", 1.0).otherwise(0.0)
    framed = defined("frame_start") & defined("frame_length")
    rows = ornaments.withColumn("index", F.row_number().over(Window.partitionBy("perf_id").orderBy("date", "id")))
    framed_rows, *tolerances = by_performance(rows.where(framed), tick_tolerance, intensity_tolerance, gradient_tolerance)
    points = framed_rows.select(*[c for c in framed_rows.columns if c.startswith("_o_")], "perf_id", "index", "frame_start", "frame_length", F.coalesce(F.nullif("intensity", F.lit(0.0)), F.lit(1.0)).alias("strength"), code.alias("shift"), F.coalesce("transition_from", F.lit(0.0)).alias("g0"), F.coalesce("transition_to", F.lit(0.0)).alias("g1"))
    first = relops.cluster(points, {"frame_start": tolerances[0], "frame_length": tolerances[0], "strength": tolerances[1], "shift": 0.0})
    first = first.withColumnRenamed("label", "outer")
    second = relops.cluster(first.where("outer >= 0"), {"g0": tolerances[2], "g1": tolerances[2]}, ("perf_id", "outer"))
    labelled = first.join(second.select("perf_id", "outer", "index", "label"), ["perf_id", "outer", "index"], "left")
    shared = (F.col("outer") >= 0) & (F.col("label") >= 0)
    name = F.when(shared, F.concat_ws("_", F.lit("def"), F.lit("global"), F.col("outer"), F.col("label"))).otherwise(F.concat_ws("_", F.lit("def"), F.lit("single"), F.col("index")))
    labelled = labelled.withColumn("def_name", name).select("perf_id", "index", "def_name", "strength", "g0", "g1")
    joined = rows.join(labelled, ["perf_id", "index"], "left")
    defs = joined.where("def_name IS NOT NULL").groupBy("perf_id", F.col("def_name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("frame_start").alias("frame_start"), F.avg("frame_length").alias("frame_length"), F.avg("strength").alias("intensity"),
        F.avg("g0").alias("transition_from"), F.avg("g1").alias("transition_to"), F.min_by("noteoff_shift", "index").alias("noteoff_shift"), F.min_by("time_unit", "index").alias("time_unit"),
    )
    has = F.col("def_name").isNotNull()
    out = joined.withColumn("name_ref", F.coalesce("def_name", "name_ref"))
    for c in ("noteoff_shift", "time_unit", "transition_from", "transition_to", "frame_start", "frame_length"):
        out = out.withColumn(c, F.when(~has, F.col(c)))
    return out.select(*ornaments.columns), defs


def compressed(definitions: DataFrame, precision: int = 0) -> DataFrame:
    """Frames of ornament definitions rounded to so many decimals."""
    rows, precision = by_performance(definitions, precision)
    unit = F.pow(F.lit(10.0), precision) if isinstance(precision, Column) else float(10**precision)
    rounded = lambda c: (F.floor(F.col(c) * unit + 0.5) / unit)
    return rows.withColumn("frame_start", rounded("frame_start")).withColumn("frame_length", rounded("frame_length")).select(*definitions.columns)
