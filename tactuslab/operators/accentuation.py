"""Metrical accentuation: beat patterns of residual velocities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.functions.kernels import accentuation_at, js_round
from tactuslab.model import PPQ, WHOLE, by_performance, in_scope, listed
from tactuslab.operators import relops


def _length(start: int | Column, end: int | Column) -> int | Column:
    """Of a cell; of an empty one none."""
    return F.nullif(end - start, F.lit(0)) if isinstance(start, Column) else end - start


def beat_velocities(notes: DataFrame, meta: DataFrame, start: int, end: int, beat_length: float = 0.25, scope: int | None = None) -> DataFrame:
    """Mean residual velocity by cell and beat: every cell as long as the first, to the end of the piece, all at once.

    Beats of a cell include its end, so a date on a border belongs to two cells.
    """
    rows, first, scope = by_performance(notes, start, scope)
    rows = rows.where(F.col("abs_vel_change").isNotNull() & in_scope(scope) & (F.col("date") >= first))
    c = rows.groupBy("perf_id", "date").agg(F.avg("abs_vel_change").alias("mean"))
    c, start, end, beat_length = by_performance(c, start, end, beat_length)
    length, step = _length(start, end), beat_length * WHOLE
    cell = F.floor((F.col("date") - start) / length)
    c = c.withColumn("cell", F.explode(F.when((cell > 0) & ((F.col("date") - start) % length == 0), F.array(cell, cell - 1)).otherwise(F.array(cell))))
    off = F.col("date") - start - F.col("cell") * length
    c = c.withColumn("off", off).where(F.col("off") % step == 0)
    return c.join(meta, "perf_id").select("perf_id", "cell", (F.col("ts_denominator") * F.col("off") / float(WHOLE) + 1).alias("beat"), F.col("mean").alias("velocity"))


def patterns(velocities: DataFrame, neutral_end: bool = False) -> DataFrame:
    """Accents by cell: each beat's velocity over the cell's largest, and the next beat's, where the last ends. scale is that largest."""
    cell = Window.partitionBy("perf_id", "cell")
    w = cell.orderBy("beat")
    rows = velocities.withColumn("scale", F.max(F.abs("velocity")).over(cell)).where("scale <> 0")
    rows = rows.withColumn("value", F.col("velocity") / F.col("scale")).withColumn("_next", F.lead("value").over(w)).withColumn("_after", F.lead("value", 2).over(w))
    rows, neutral_end = by_performance(rows, neutral_end)
    to = F.when(F.col("_after").isNull() & F.lit(neutral_end), 0.0).otherwise(F.col("_next"))
    return rows.where("_next IS NOT NULL").select("perf_id", "cell", "beat", "value", F.col("value").alias("transition_from"), to.alias("transition_to"), "scale")


def scales(velocities: DataFrame) -> DataFrame:
    return velocities.groupBy("perf_id", "cell").agg(F.max(F.abs("velocity")).alias("scale"))


def looped(notes: DataFrame, meta: DataFrame, start: int, end: int, beat_length: float = 0.25, neutral_end: bool = False, scale_tolerance: float = 0.0, next_date: int | None = None, scope: int | None = None) -> DataFrame:
    """For each performance the pattern of the first cell (children), its scale, and how far it loops.

    Later cells go on while their accents round alike and their scale is near the running mean, which
    leaves out the first cell once a second is taken in. The check of a cell needs the mean before it, so
    cells are folded in order as an array: one short row a cell.
    """
    v = beat_velocities(notes, meta, start, end, beat_length, scope)
    p = patterns(v, neutral_end)
    first = p.where("cell = 0").groupBy("perf_id").agg(F.array_sort(F.collect_list(F.struct("beat", "value", "transition_from", "transition_to"))).alias("children"), F.first("scale").alias("s0"))
    base = p.where("cell = 0").select("perf_id", "beat", js_round(F.col("value")).alias("r0"))
    later = p.where("cell > 0").join(base, ["perf_id", "beat"], "left").groupBy("perf_id", "cell").agg(F.bool_and(F.coalesce(js_round(F.col("value")) == F.col("r0"), F.lit(True))).alias("same"))
    later = scales(v).where("cell > 0").join(later, ["perf_id", "cell"], "left").withColumn("same", F.coalesce("same", F.lit(True)))
    cells = later.groupBy("perf_id").agg(F.array_sort(F.collect_list(F.struct("cell", "scale", "same"))).alias("cells"))
    rows = first.join(cells, "perf_id", "left").join(relops.ends(notes), "perf_id")
    rows, start, end, scale_tolerance = by_performance(rows, start, end, scale_tolerance)
    length = _length(start, end)
    stop = F.least(F.lit(next_date), F.col("end_date")) if next_date is not None else F.col("end_date")
    tried = F.greatest(F.ceil((stop - end) / (length.cast("double") if isinstance(length, Column) else float(length))), F.lit(0)).cast("int")

    def step(s, k):
        own = F.try_element_at(F.filter(F.col("cells"), lambda c: c.cell == k), F.lit(1))
        ok = s.on & own.isNotNull() & (own.scale != 0) & own.same & (F.abs(own.scale - s.scale) <= scale_tolerance)
        ok = F.coalesce(ok, F.lit(False))
        return F.struct(F.when(ok, (s.scale * s.n + own.scale) / (s.n + 1)).otherwise(s.scale).alias("scale"), (s.n + ok.cast("int")).alias("n"), F.when(s.on, k).otherwise(s.last).alias("last"), ok.alias("on"))

    begin = F.struct(F.col("s0").alias("scale"), F.lit(0).alias("n"), F.lit(0).alias("last"), F.lit(True).alias("on"))
    fold = F.when(tried > 0, F.aggregate(F.sequence(F.lit(1), tried), begin, step)).otherwise(begin)
    rows = rows.withColumn("f", fold)
    at = F.lit(start) + F.col("f.last") * length
    return rows.select("perf_id", "children", F.col("f.scale").alias("scale"), F.col("f.n").alias("repeats"), (at > end).alias("loop"), F.when(at > end, at).alias("neutral_date"))


def accent_residual(notes: DataFrame, found: DataFrame, meta: DataFrame, start: int, end: int, next_date: int | None = None, scope: int | None = None) -> DataFrame:
    """notes with the pattern's accent taken out of abs_vel_change, within its cell or its loop."""
    out = notes.columns
    rows, start, end, scope = by_performance(notes.join(found, "perf_id", "left").join(meta, "perf_id", "left"), start, end, scope)
    length = _length(start, end) * 1.0
    stop = F.coalesce(F.col("neutral_date"), F.lit(next_date).cast("long"))
    inside = (F.col("date") >= start) & (F.col("loop") | (F.col("date") < start + length)) & (stop.isNull() | (F.col("date") < stop)) & in_scope(scope)
    beat = 1 + ((F.col("date") - start) % length) / float(PPQ)
    beats = length / WHOLE * F.col("ts_denominator")
    reached = F.coalesce(F.get("children", F.lit(0))["beat"] <= beat, F.lit(False))
    change = accentuation_at(beat, F.col("children"), beats) * F.col("scale")
    value = F.when(F.coalesce(inside, F.lit(False)) & reached & F.col("abs_vel_change").isNotNull(), F.col("abs_vel_change") - change).otherwise(F.col("abs_vel_change"))
    return rows.withColumn("abs_vel_change", value).select(*out)


def merged(accents: DataFrame, names: list[str], into: str) -> DataFrame:
    """Accents of definitions (perf_id, pos, name, beat, value, transition_from, transition_to) merged under one name.

    The first definition's beats stay; each further one moves those it shares by one part in its rank.
    Fewer than two named definitions stay as they are.
    """
    own, names = by_performance(accents, names)
    own = own.where(listed(names, "name"))
    rank = F.dense_rank().over(Window.partitionBy("perf_id").orderBy("pos"))
    own = own.withColumn("rank", rank)
    many = own.groupBy("perf_id").agg(F.max("rank").alias("m")).where("m > 1").select("perf_id")
    value = F.struct("rank", "value", "transition_from", "transition_to")
    g = own.join(many, "perf_id").groupBy("perf_id", "beat").agg(F.array_sort(F.collect_list(value)).alias("v")).where(F.get("v", F.lit(0))["rank"] == 1)

    def fold(c: str):
        rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
        return F.aggregate(rest, F.get("v", F.lit(0))[c], lambda s, x: (s * (x.rank - 1) + x[c]) / x.rank).alias(c)

    g, into = by_performance(g, into)
    return g.select("perf_id", F.lit(into).alias("name"), "beat", fold("value"), fold("transition_from"), fold("transition_to"))
