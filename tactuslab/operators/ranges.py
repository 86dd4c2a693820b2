"""Tables of half-open ranges (perf_id, start, end): what they cover, where they overlap, and what becomes of instructions under them.

All of it is one sweep: every range raises a count where it starts and lowers it where it ends. Ranges
that end where they start, or before, or lack an end, hold nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.operators import relops


def _depths(ranges: DataFrame) -> DataFrame:
    """perf_id, at, depth from there to until, and how many ranges start there: one row for each place at which one starts or ends."""
    known = ranges.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") < F.col("end")))
    edges = known.select("perf_id", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("x"))
    places = edges.groupBy("perf_id", F.col("x.at").alias("at")).agg(F.sum("x.step").alias("step"), F.count(F.when(F.col("x.step") > 0, 1)).alias("starts"))
    w = Window.partitionBy("perf_id").orderBy("at")
    return places.withColumn("depth", F.sum("step").over(w)).withColumn("until", F.lead("at").over(w)).drop("step")


def coverage(ranges: DataFrame) -> DataFrame:
    """perf_id, start, end and n_ranges of what is covered without a gap; ranges that touch are one."""
    w = Window.partitionBy("perf_id").orderBy("at")
    rows = _depths(ranges).withColumn("_begins", (F.lag("depth", 1, 0).over(w) == 0).cast("int"))
    rows = rows.withColumn("_part", F.sum("_begins").over(w))
    return rows.groupBy("perf_id", "_part").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.sum("starts").alias("n_ranges")).drop("_part")


def overlaps(ranges: DataFrame) -> DataFrame:
    """perf_id, start, end and depth of each stretch that two or more of the same ranges cover."""
    return _depths(ranges).where("depth > 1").select("perf_id", F.col("at").alias("start"), F.col("until").alias("end"), "depth")


def members(points: DataFrame, ranges: DataFrame, at: str = "date") -> DataFrame:
    """points with range_start and range_end of each range that holds them, both ends included.

    The ranges of a performance mustn't overlap, as those of coverage don't. A point where one ends and the
    next starts is in both; one in none is left out.
    """
    r = ranges.where(F.col("start") < F.col("end"))
    w = Window.partitionBy("perf_id").orderBy("start")
    r = r.select("perf_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.lag("start").over(w).alias("_ps"), F.lag("end").over(w).alias("_pe"))
    found = relops.asof(points, r.withColumn("_begin", F.col("_s")).withColumn(at, F.col("_s")), ["_begin", "_e", "_ps", "_pe"], at=at, prefix="_r")
    here = F.when(F.col(at) <= F.col("_r_e"), F.struct(F.col("_r_begin").alias("range_start"), F.col("_r_e").alias("range_end")))
    before = F.when(F.col(at) == F.col("_r_pe"), F.struct(F.col("_r_ps").alias("range_start"), F.col("_r_pe").alias("range_end")))
    both = F.explode(F.filter(F.array(before, here), lambda x: x.isNotNull()))
    return found.withColumn("_x", both).select(*points.columns, "_x.range_start", "_x.range_end")


def uncovered(instructions: DataFrame, ranges: DataFrame) -> DataFrame:
    """instructions outside the ranges, with restored: where one was in force at the end of what is covered, it begins anew there.

    One that has a successor at that very date isn't restored, nor one that was in force there without any
    instruction having gone.
    """
    covered = coverage(ranges).withColumn("_begin", F.col("start"))
    columns = instructions.columns
    placed = relops.asof(instructions, covered.select("perf_id", F.col("start").alias("date"), "_begin", F.col("end").alias("_end")), ["_begin", "_end"], prefix="_r")
    gone = F.coalesce(F.col("date") < F.col("_r_end"), F.lit(False))
    kept = placed.where(~gone).select(*columns, F.lit(False).alias("restored"))
    last = placed.where(gone).groupBy("perf_id", "_r_end").agg(F.max_by(F.struct(*columns), "date").alias("t"))
    have = instructions.select("perf_id", F.col("date").alias("_r_end"))
    again = last.join(have, ["perf_id", "_r_end"], "left_anti").select("t.*", "_r_end").withColumn("date", F.col("_r_end").cast(dict(instructions.dtypes)["date"]))
    return kept.unionByName(again.select(*columns, F.lit(True).alias("restored")))
