"""Articulation: how long and how loud single notes are played, and styles clustered from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.model import by_performance
from tactuslab.operators import relops

ASPECTS = ("rel_dur", "rel_vel", "abs_dur", "abs_dur_change")


def values(notes: DataFrame) -> DataFrame:
    """All aspects of each note: relative to its score duration and its velocity, and in ticks."""
    ticks = F.col("tick_duration")
    return notes.select(
        "perf_id", "note_id", "seq", "date",
        F.when(ticks != 0, ticks / F.col("duration")).alias("rel_dur"),
        ((F.coalesce("abs_vel_change", F.lit(0.0)) + F.col("velocity")) / F.nullif("velocity", F.lit(0.0))).alias("rel_vel"),
        ticks.alias("abs_dur"), (ticks - F.col("duration")).alias("abs_dur_change"),
    )


def definition(chosen: DataFrame, aspects: tuple[str, ...]) -> DataFrame:
    """Mean of the selected aspects of the chosen notes' values; the others are null."""
    rows, wanted = by_performance(chosen.groupBy("perf_id").agg(*relops.means_in_order(ASPECTS, "seq", "note_id")), aspects)
    keep = lambda a: F.when(F.array_contains(wanted, a), F.col(a)) if isinstance(wanted, Column) else F.col(a) if a in wanted else F.lit(None).cast("double")
    return rows.select("perf_id", *[keep(a).alias(a) for a in ASPECTS])


def instructions(chosen: DataFrame, name: str) -> DataFrame:
    """One articulation for each date: the ids of its notes in order."""
    ids = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("#"), F.col("note_id").cast("string")).alias("id"))))
    rows, name = by_performance(chosen.groupBy("perf_id", "date").agg(F.transform(ids, lambda x: x.id).alias("noteid")), name)
    return rows.select("perf_id", "date", "noteid", F.lit(name).alias("name_ref"))


def undone(notes: DataFrame, chosen: DataFrame, defs: DataFrame) -> DataFrame:
    """notes without the definition's effect on the chosen ones, aspect by aspect."""
    d = defs.select("perf_id", *[F.col(a).alias(f"_{a}") for a in ASPECTS])
    hits = chosen.select("perf_id", "note_id", "seq").withColumn("_hit", F.lit(True))
    rows = notes.join(hits, ["perf_id", "note_id", "seq"], "left").join(d, "perf_id", "left")
    ticks = F.when(F.col("_rel_dur").isNotNull(), F.col("tick_duration") / F.col("_rel_dur")).otherwise(F.col("tick_duration"))
    ticks = F.when(F.col("_abs_dur").isNotNull(), F.col("duration").cast("double")).otherwise(ticks)
    ticks = F.when(F.col("_abs_dur_change").isNotNull(), ticks - F.col("_abs_dur_change")).otherwise(ticks)
    change = F.when(F.col("_hit") & F.col("_rel_vel").isNotNull(), 0.0).otherwise(F.col("abs_vel_change"))
    return rows.withColumn("tick_duration", F.when(F.col("_hit"), ticks).otherwise(F.col("tick_duration"))).withColumn("abs_vel_change", change).select(*notes.columns)


def conflicts(notes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Notes (perf_id, note_id, seq) that, at a relative duration of lengths (perf_id, note_id, seq, mean), would run into the next of their pitch.

    lengths may have further columns, which come along. Only the next onset of the pitch can be the first to be met, so each note looks at one other.
    """
    # From the last onset on, each note keeps the last one that was another: one sort for both windows.
    later = Window.partitionBy("perf_id", "midi_pitch").orderBy(F.desc("tick_date"))
    rows = notes.where(F.col("tick_date").isNotNull()).withColumn("_later", F.lag("tick_date").over(later))
    other = F.when(F.col("_later") != F.col("tick_date"), F.col("_later"))
    rows = rows.withColumn("_next", F.last(other, ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = rows.join(lengths, ["perf_id", "note_id", "seq"]).where(F.col("tick_date") + F.col("duration") * F.col("mean") > F.col("_next"))
    return hit.select(*[c for c in lengths.columns if c != "mean"])


def clustered(articulated: DataFrame, volume_tolerance: float = 0.01, duration_tolerance: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Articulations (perf_id, seq, rel_dur, rel_vel and more) with the label of their cluster, and a definition for each.

    is_default marks each performance's largest cluster, the first of equals.
    """
    rows, duration_tolerance, volume_tolerance = by_performance(articulated.withColumn("index", F.row_number().over(Window.partitionBy("perf_id").orderBy("seq"))), duration_tolerance, volume_tolerance)
    found = relops.cluster(rows, {"rel_dur": duration_tolerance, "rel_vel": volume_tolerance}).select(*articulated.columns, "index", "label")
    defs = found.where("label >= 0").groupBy("perf_id", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("rel_dur").alias("rel_dur"), F.avg("rel_vel").alias("rel_vel"))
    best = F.row_number().over(Window.partitionBy("perf_id").orderBy(F.desc("n"), "label")) == 1
    return found, defs.withColumn("is_default", best).withColumn("name", F.concat(F.lit("def_"), F.col("label")))


def stylized(articulated: DataFrame, notes: DataFrame, volume_tolerance: float = 0.01, duration_tolerance: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Articulations (perf_id, note_id, seq, rel_dur, rel_vel) of single notes with label and conflict, and definitions of the clusters."""
    found, defs = clustered(articulated, volume_tolerance, duration_tolerance)
    lengths = found.join(defs.select("perf_id", "label", F.col("rel_dur").alias("mean")), ["perf_id", "label"]).select("perf_id", "note_id", "seq", "mean")
    clash = conflicts(notes, lengths).withColumn("conflict", F.lit(True))
    out = found.join(clash, ["perf_id", "note_id", "seq"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return out, defs
