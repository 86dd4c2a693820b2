"""Lookups, edits and means over notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.model import by_performance, defined, in_scope, listed, within
from tactuslab.operators.relops import mean_in_order


def at_date(notes: DataFrame, date: int, scope: int | None = None) -> DataFrame:
    return notes.where((F.col("date") == date) & in_scope(scope))


def in_part(notes: DataFrame, scope: int | None) -> DataFrame:
    return notes.where(in_scope(scope))


def in_range(notes: DataFrame, start: int, end: int, scope: int | None = None) -> DataFrame:
    """Both ends belong to the range."""
    return notes.where(F.col("date").between(start, end) & in_scope(scope))


def by_id(notes: DataFrame, note_ids: list) -> DataFrame:
    """The first row of each performance with one of the ids."""
    w = Window.partitionBy("perf_id", "note_id").orderBy("seq")
    rows, note_ids = by_performance(notes, note_ids)
    return rows.where(listed(note_ids)).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*notes.columns)


def by_id_all(notes: DataFrame) -> DataFrame:
    """The first row of each id."""
    w = Window.partitionBy("perf_id", "note_id").orderBy("seq")
    return notes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def with_attributes(notes: DataFrame, note_id, attributes: dict[str, str]) -> DataFrame:
    """Note attributes laid into attrs of the first row with an id."""
    more = F.create_map(*[F.lit(x) for pair in attributes.items() for x in pair])
    first = F.row_number().over(Window.partitionBy("perf_id", "note_id").orderBy("seq")) == 1
    old = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(attributes)))
    return notes.withColumn("_f", first).withColumn("attrs", F.when(F.col("_f") & (F.col("note_id") == note_id), F.map_concat(kept, more)).otherwise(F.col("attrs"))).drop("_f")


def parts(notes: DataFrame) -> DataFrame:
    return notes.select("perf_id", (F.col("part") - 1).alias("scope")).distinct()


def extent(notes: DataFrame) -> DataFrame:
    """last_date and end_date of each performance."""
    return notes.groupBy("perf_id").agg(F.max("date").alias("last_date"), F.max(F.col("date") + F.col("duration")).alias("end_date"))


def last_note(notes: DataFrame) -> DataFrame:
    """Of the notes of the last date the first."""
    return notes.groupBy("perf_id").agg(F.max_by("note_id", F.struct("date", -F.col("seq"))).alias("note_id"), F.max("date").alias("date"))


def range_of(notes: DataFrame, start: int | None = None, end: int | None = None, date: int | None = None, length: int | None = None, note_ids: list | None = None) -> DataFrame:
    """from_date and to_date that options cover: a range itself, a date with its length, or the notes' first and last date."""
    lit = lambda x: F.lit(x).cast("long")
    if note_ids is not None:
        return notes.where(F.col("note_id").isin(note_ids)).groupBy("perf_id").agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"))
    if start is not None:
        a, b = start, end
    else:
        a, b = date, None if length is None or date is None else date + length
    return notes.select("perf_id").distinct().select("perf_id", lit(a).alias("from_date"), lit(b).alias("to_date"))


def pedal_range(pedals: DataFrame, start: float, duration: float, direction: str) -> DataFrame:
    """The extent of a pedal's movement: from the pressing or, for direction up, the release."""
    base = F.col("tick_date") if direction == "down" else F.col("tick_date") + F.col("tick_duration")
    return pedals.where(F.col("tick_date").isNotNull() & F.col("tick_duration").isNotNull()).groupBy("perf_id").agg(F.min(base + start).alias("from_date"), F.max(base + start + duration).alias("to_date"))


def shift_to_first_onset(notes: DataFrame, pedals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Onsets from the first note's on. Pedals that begin earlier lose what lies before; without onsets nothing moves."""
    first = F.min(F.when(defined("onset"), F.col("onset"))).over(Window.partitionBy("perf_id"))
    moved = notes.withColumn("_m", first).withColumn("onset", F.when(defined("onset"), F.col("onset") - F.col("_m")).otherwise(F.col("onset"))).drop("_m")
    firsts = notes.where(defined("onset")).groupBy("perf_id").agg(F.min("onset").alias("_m"))
    p = pedals.join(firsts, "perf_id", "left")
    early = F.col("onset") < F.col("_m")
    duration = F.when(early, F.col("midi_duration") - (F.col("_m") - F.col("onset"))).otherwise(F.col("midi_duration"))
    onset = F.when(early, 0.0).otherwise(F.col("onset") - F.coalesce("_m", F.lit(0.0)))
    return moved, p.withColumns({"midi_duration": duration, "onset": onset}).drop("_m")


def modify(notes: DataFrame, aspect: str, change: float, start: int | None = None, end: int | None = None, note_ids: list | None = None, scope: int | None = None) -> DataFrame:
    """Add change to velocity (never below 0), onset or duration of notes in a closed range, or of ids whatever their part."""
    out = notes.columns
    notes, aspect, change, start, end, note_ids, scope = by_performance(notes, aspect, change, start, end, note_ids, scope)
    inside = F.col("date").between(start, end) & in_scope(scope)
    hit = F.when(note_ids.isNotNull(), listed(note_ids)).otherwise(inside) if isinstance(note_ids, Column) else inside if note_ids is None else listed(note_ids)
    columns: dict[str, tuple[str, Column]] = {
        "velocity": ("velocity", F.greatest(F.lit(0.0), F.col("velocity") + change)),
        "onset": ("onset", F.col("onset") + change),
        "duration": ("midi_duration", F.col("midi_duration") + change),
    }
    if isinstance(aspect, Column):
        return notes.withColumns({name: F.when((aspect == a) & hit, value).otherwise(F.col(name)) for a, (name, value) in columns.items()}).select(*out)
    if aspect not in columns:
        raise ValueError(f"no such aspect: {aspect}")
    name, value = columns[aspect]
    return notes.withColumn(name, F.when(hit, value).otherwise(F.col(name))).select(*out)


def make_choice(notes: DataFrame, timing: str, velocity: str | None = None, start: int | None = None, end: int | None = None, note_ids: list | None = None) -> DataFrame:
    """Of takes of one note (equal date, duration and pitch) keep the first with the preferred source.

    Its velocity may come from another source's take. Notes without a take of the preferred source, and
    notes outside the range or the ids, stay as they are. A kept note goes to the end of the order.
    """
    out = notes.columns
    notes, timing, velocity, start, end, note_ids = by_performance(notes, timing, velocity, start, end, note_ids)
    affected, sourced = F.lit(True), F.col("source").isNotNull() & (F.col("source") != "")
    if isinstance(start, Column) or isinstance(note_ids, Column):
        affected = F.when(F.lit(start).isNotNull(), sourced & within(start, end)).when(F.lit(note_ids).isNotNull(), sourced & listed(note_ids)).otherwise(F.lit(True))
    elif start is not None:
        affected = sourced & within(start, end)
    elif note_ids is not None:
        affected = sourced & listed(note_ids)
    rows = notes.withColumn("_a", F.coalesce(affected, F.lit(False)))
    group = Window.partitionBy("perf_id", "_a", "date", "duration", "midi_pitch")
    keep = F.min(F.when(F.col("source") == timing, F.col("seq"))).over(group)
    rows = rows.withColumn("_keep", F.when(F.col("_a"), keep))
    if isinstance(velocity, Column) or (velocity is not None and not isinstance(timing, Column) and velocity != timing):
        other = F.min_by(F.when(F.col("source") == velocity, F.col("velocity")), F.when(F.col("source") == velocity, F.col("seq"))).over(group)
        rows = rows.withColumn("_v", other).withColumn("velocity", F.when(F.col("_keep") == F.col("seq"), F.coalesce("_v", "velocity")).otherwise(F.col("velocity"))).drop("_v")
    rows = rows.where(F.col("_keep").isNull() | (F.col("_keep") == F.col("seq")))
    per = Window.partitionBy("perf_id")
    top = F.max("seq").over(per)
    rank = F.row_number().over(per.orderBy(F.col("_keep").isNull(), "seq"))
    rows = rows.withColumn("_top", top).withColumn("_rank", rank)
    return rows.withColumn("seq", F.when(F.col("_keep").isNotNull(), F.col("_top") + F.col("_rank")).otherwise(F.col("seq"))).select(*out)


def choose_pedals(pedals: DataFrame, source: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Pedals of the preferred source; with a range those outside it too, and those without a date count as inside."""
    rows, source, start, end = by_performance(pedals, source, start, end)
    wanted = F.col("source") == source
    if isinstance(source, Column):  # none wanted: all stay
        wanted = wanted | source.isNull() | (source == "")
    if start is None:
        return rows.where(wanted).select(*pedals.columns)
    date = F.col("date") if "date" in pedals.columns else F.lit(None).cast("double")
    return rows.where(wanted | (date < start) | (date > end)).select(*pedals.columns)


def make_default_articulation(notes: DataFrame, articulated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean relative duration of notes that no articulation names (or dates), and notes with it undone.

    articulated has perf_id, date and noteid, an array that is null where an articulation is its whole date's.
    """
    named = articulated.where("noteid IS NOT NULL").select("perf_id", F.explode("noteid").alias("note_id")).distinct()
    dated = articulated.where("noteid IS NULL").select("perf_id", "date").distinct()
    free = notes.join(named, ["perf_id", "note_id"], "left_anti").join(dated, ["perf_id", "date"], "left_anti")
    ratio = F.col("tick_duration") / F.col("duration")
    mean = free.where(defined(ratio)).groupBy("perf_id").agg(mean_in_order(ratio, "seq", "note_id").alias("rel_dur"))
    undone = notes.join(free.select("perf_id", "note_id", "seq", F.lit(True).alias("_free")), ["perf_id", "note_id", "seq"], "left").join(mean, "perf_id", "left")
    value = F.when(F.col("_free") & F.col("rel_dur").isNotNull(), F.col("tick_duration") / F.col("rel_dur")).otherwise(F.col("tick_duration"))
    return mean, undone.withColumn("tick_duration", value).select(*notes.columns)


def asynchrony(notes: DataFrame, part: int = 1, start: int = 0, end: int = 0) -> tuple[DataFrame, DataFrame]:
    """Mean shift in seconds of a part's first notes against the other part's at the same dates; and notes without it.

    part is a scope: 0 or 1. Without dates in common nothing is shifted.
    """
    out = notes.columns
    heads = notes.groupBy("perf_id", "date", (F.col("part") - 1).alias("scope")).agg(F.min_by("onset", "seq").alias("onset"))
    heads, *at = by_performance(heads, part, start, end)
    a = heads.where((F.col("scope") == at[0]) & F.col("date").between(at[1], at[2])).select("perf_id", "date", F.col("onset").alias("a"))
    b = heads.where(F.col("scope") == F.when(F.lit(at[0]) == 1, 0).otherwise(1)).select("perf_id", "date", F.col("onset").alias("b"))
    notes, part, start, end = by_performance(notes, part, start, end)
    own = in_scope(part)
    shift = a.join(b, ["perf_id", "date"]).where("a IS NOT NULL AND b IS NOT NULL").groupBy("perf_id").agg(mean_in_order(F.col("a") - F.col("b"), "date").alias("shift"))
    moved = notes.join(shift, "perf_id", "left")
    value = F.when(own & F.col("date").between(start, end), F.col("onset") - F.coalesce("shift", F.lit(0.0))).otherwise(F.col("onset"))
    return shift, moved.withColumn("onset", value).select(*out)


def pedal_movements(pedals: DataFrame, start: float, duration: float, direction: str, depth: float | None = None, pedal_id=None) -> DataFrame:
    """Two movements for each pedal with ticks: down to a depth at its beginning, or up from it at its end."""
    rows = pedals.where(F.col("tick_date").isNotNull() & F.col("tick_duration").isNotNull())
    rows, start, duration, direction, depth, pedal_id = by_performance(rows, start, duration, direction, depth, pedal_id)
    if isinstance(pedal_id, Column):
        rows = rows.where(pedal_id.isNull() | (F.col("pedal_id") == pedal_id))
    elif pedal_id is not None:
        rows = rows.where(F.col("pedal_id") == pedal_id)
    down = F.lit(direction) == "down"
    depth = F.coalesce(F.nullif(F.lit(depth).cast("double"), F.lit(0.0)), F.lit(1.0))
    either = lambda a, b: F.when(down, a).otherwise(b)
    base = either(F.col("tick_date"), F.col("tick_date") + F.col("tick_duration"))

    def movement(name: Column, date: Column, position: Column, to: Column) -> Column:
        ident = F.concat(F.col("pedal_id").cast("string"), name)
        return F.struct(ident.alias("id"), date.alias("date"), position.alias("position"), to.cast("double").alias("transition_to"))

    low, high = either(F.lit(0.0), depth), either(depth, F.lit(0.0))
    both = F.array(movement(either("_start", "_moveUp"), base + start, low, high), movement(either("_moveDown", "_end"), base + start + duration, high, F.lit(None)))
    return rows.select("perf_id", F.col("type").alias("controller"), F.explode(both).alias("m")).select("perf_id", "m.id", "m.date", "m.position", "m.transition_to", "controller")


def imprecision_limits(predefined: float) -> tuple[float, float]:
    """Limits of timing imprecision that a predefined amount stands for. Nothing is inserted."""
    return -(10 - predefined / 2), 10 - predefined / 2
