"""Running values over ranges against windows over whole keys."""

import random

from pyspark.sql import functions as F

from tactuslab.operators import relops, scan


def _rows(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None]), i, r.randint(-5, 9), float(r.randint(0, 50)) if r.random() < 0.05 else None, float(r.randint(0, 90))) for i in range(n)]
    return spark.createDataFrame(rows, "perf_id int, seq int, step int, anchor double, date double")


def _same(a, b):
    key = lambda df: sorted(map(repr, (r.asDict() for r in df.select(*sorted(b.columns)).collect())))
    assert key(a) == key(b)


def test_running_sums_and_numbers(spark):
    rows = _rows(spark)
    by = {}
    for r in sorted(rows.collect(), key=lambda r: r["seq"]):
        by.setdefault(r["perf_id"], []).append(r)
    want = {r["seq"]: (sum(x["step"] for x in some[: k + 1]), k + 1) for some in by.values() for k, r in enumerate(some)}
    got = scan.running(rows, ["seq"], {"total": "step", "rank": F.lit(1)}, ["perf_id"], n=9).collect()
    assert {r["seq"]: (r["total"], r["rank"]) for r in got} == want
    got = scan.running(rows, ["seq"], {"total": "step"}, ["perf_id"], n=9, before=True).collect()
    assert all(r["total"] == want[r["seq"]][0] - r["step"] for r in got)
    got = scan.numbered(rows, [F.col("seq").desc()], n=7).collect()  # without keys: one order of all
    assert all(r["rank"] == 400 - r["seq"] for r in got)


def test_resets_reach_over_ranges(spark):
    rows = _rows(spark).where("perf_id IS NOT NULL").withColumn("step", F.col("step").cast("double"))
    for n in (1, 5, 40):
        _same(scan.running_with_resets(rows, "step", "anchor", "seq", "out", n=n), relops.running_with_resets(rows, "step", "anchor", "seq", "out"))


def test_asof_over_ranges(spark):
    left = _rows(spark).where("perf_id IS NOT NULL").withColumn("more", F.create_map(F.lit("a"), F.col("seq")))
    right = _rows(spark, 60, 8).where("perf_id IS NOT NULL").select("perf_id", "date", "seq", "step")
    want = relops.asof(left, right, ["seq", "step"], prefix="r_").drop("more")
    for n in (1, 6, 50):
        _same(scan.asof(left, right, ["seq", "step"], prefix="r_", n=n).drop("more"), want)
    _same(scan.asof(left, right.limit(0), ["seq", "step"], prefix="r_").drop("more"), relops.asof(left, right.limit(0), ["seq", "step"], prefix="r_").drop("more"))


def test_one_key_spreads_over_ranges(spark):
    rows = spark.range(20000).select(F.lit(1).alias("perf_id"), F.col("id").alias("seq"))
    sizes = scan.ranged(rows, ["seq"], ["perf_id"], n=8).groupBy("_range").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 20000 / 8
    assert scan.numbered(rows.limit(0), ["seq"], ["perf_id"]).count() == 0
