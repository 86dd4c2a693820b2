"""Segments fitted to a time, in batches: few seconds for many, and what a plain loop gives."""

import math
import time

from pyspark.sql import functions as F

from tactuslab.functions import kernels


def elapsed(a, b, m, n):
    at = [60000 / (a + (b - a) * (i / 200) ** (math.log(0.5) / math.log(m))) for i in range(201)]
    return sum((x + y) / 2 for x, y in zip(at, at[1:], strict=False)) * n / 200


def plain(a, b, m, n, t):
    if n <= 0 or t <= 0:
        return a, b, m, False
    if abs(a - b) < 0.5:
        return n * 60000 / t, n * 60000 / t, 0.5, abs(n * 60000 / t - (a + b) / 2) > 0.5
    low, high = elapsed(a, b, 0.02, n), elapsed(a, b, 0.98, n)
    if not min(low, high) <= t <= max(low, high):
        return a * elapsed(a, b, m, n) / t, b * elapsed(a, b, m, n) / t, m, True
    lo, hi = 0.02, 0.98
    for _ in range(50):
        mid = (lo + hi) / 2
        ms = elapsed(a, b, mid, n)
        if abs(ms - t) < 0.1:
            break
        lo, hi = (mid, hi) if (ms < t) == (high > low) else (lo, mid)
    return a, b, (lo + hi) / 2, False


def test_as_a_loop(spark):
    rows = [(a, b, m, n, t) for a in (50.0, 90.0, 90.3) for b in (60.0, 90.0, 140.0) for m in (0.2, 0.7) for n in (0.0, 4.0) for t in (0.0, 1500.0, 2400.0, 3100.0, 9000.0)]
    df = spark.createDataFrame(rows, "a double, b double, m double, n double, t double")
    out = df.select("*", kernels.optimized_elapsed(*[F.col(c) for c in "abmnt"]).alias("o")).collect()
    for x in out:
        want = plain(*[x[c] for c in "abmnt"])
        assert x.o.bpm_scaled == want[3] and all(abs(g - w) < 1e-9 for g, w in zip(x.o[:3], want[:3], strict=True)), x


def test_nulls(spark):
    df = spark.createDataFrame([(None, 60.0, 0.5, 4.0, 2400.0), (60.0, 90.0, None, 4.0, 3100.0)], "a double, b double, m double, n double, t double")
    first, second = (r.o for r in df.select(kernels.optimized_elapsed(*[F.col(c) for c in "abmnt"]).alias("o")).collect())
    assert first.start_bpm is None and second.mean_tempo_at is not None and not second.bpm_scaled


def test_many_in_few_seconds(spark):
    """As column expressions 60,000 segments took minutes."""
    r = spark.range(60000)
    o = kernels.optimized_elapsed(60.0 + F.col("id") % 37, 60.0 + F.col("id") % 101, F.lit(0.5), F.lit(4.0), 2000.0 + (F.col("id") % 11) * 100)
    began = time.perf_counter()
    r.select(o.alias("o")).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 20
