"""Notes under transitions of some hundred steps, and runs of rubatos of many performances: few seconds, and what the plain rule gives."""

import random
import time

from pyspark.sql import functions as F

from tactuslab.functions import kernels
from tactuslab.operators import rubato

ARGS = ("s", "e", "bpm", "beat", "t", "m")


def test_elapsed_as_by_the_rule(spark):
    r = random.Random(3)
    rows = []
    for _ in range(600):
        s = 720.0 * r.randint(0, 9)
        rows.append((s, s + 720.0 * r.randint(1, 60), r.uniform(30, 160), 0.25, r.choice([None, 0.0, r.uniform(30, 160)]), r.choice([None, r.uniform(0.1, 0.9)]), r.choice([0.0, 0.3, 1.0, 1.2])))
    t = spark.createDataFrame(rows, "s double, e double, bpm double, beat double, t double, m double, share double")
    args, at = [F.col(a) for a in ARGS], F.col("s") + F.floor((F.col("e") - F.col("s")) * F.col("share"))
    out = t.select(kernels.ms_at(at, *args).alias("want"), kernels.elapsed_at(at, *args).alias("got")).collect()
    assert all(abs(x.want - x.got) <= 1e-9 * max(1, x.want) for x in out)


def test_many_notes_under_a_long_transition(spark):
    """As column expressions 60,000 dates in a transition of sixty quarters took about a minute of four cores."""
    rows = spark.range(60000, numPartitions=4).select(*[F.lit(x).alias(c) for c, x in zip(ARGS, (0.0, 43200.0, 60.0, 0.25, 90.0, 0.4), strict=True)], (F.col("id") * 0.6).alias("ms"))
    args = [F.col(a) for a in ARGS]
    timed = rows.withColumn("table", kernels.elapsed_table(*args)).withColumn("at", kernels.date_at(F.col("ms"), *args, table=F.col("table")))
    began = time.perf_counter()
    timed.agg(F.sum("at")).collect()
    assert time.perf_counter() - began < 8


def test_rubatos_of_many_performances(spark):
    """A call of Python for each performance took some ten milliseconds, in as few tasks as the rows' bytes fill."""
    none = F.lit(None).cast("double")
    rows = spark.range(9000).select((F.col("id") / 3).cast("long").alias("perf_id"), (F.col("id") % 3 * 720.0).alias("date"), F.lit(720.0).alias("frame_length"), F.lit(1.2).alias("intensity"), none.alias("late_start"), none.alias("early_end"))
    last = spark.range(3000).select(F.col("id").alias("perf_id"), F.lit(7200).cast("long").alias("last_date"))
    began = time.perf_counter()
    found = rubato.combined(rows, last).groupBy("date", "loop").count().collect()
    assert {(x.date, x.loop): x["count"] for x in found} == {(0.0, True): 3000, (2160.0, False): 3000}
    assert time.perf_counter() - began < 8
