"""SQL functions against the columns of the same names."""

import pytest
from pyspark.sql import functions as F

from tactuslab.functions import kernels

ROWS = [(d, 0.0, 2880.0, 60.0 + k, [90.0, None, 60.0 + k, 0.0][k % 4], [0.3, None, 0.7][k % 3], 0.8 + k / 10, [None, 0.2][k % 2], [0.9, None][k % 2], k / 12, [0.0, 0.4, -0.4][k % 3]) for k, d in enumerate([0.0, 1.0, 90.0, 200.0, 719.0, 1440.0, 1441.5, 2000.0, 2879.0, 2880.0, 3000.0])]
NAMES = "date double, s double, e double, bpm double, to double, m double, i double, late double, early double, c double, p double"


def test_functions(spark):
    kernels.register(spark)
    t = spark.createDataFrame(ROWS, NAMES)
    t.createOrReplaceTempView("kernel_rows")
    c = {x.split()[0]: F.col(x.split()[0]) for x in NAMES.split(", ")}
    pairs = {
        "js_round(date / 7)": kernels.js_round(c["date"] / 7),
        "clamp(10, date, 1000)": kernels.clamp(10.0, c["date"], 1000.0),
        "rubato_on_date(date, s, e, i, late, early)": kernels.rubato_on_date(c["date"], c["s"], c["e"], c["i"], c["late"], c["early"]),
        "tempo_at(date, s, e, bpm, to, m)": kernels.tempo_at(c["date"], c["s"], c["e"], c["bpm"], c["to"], c["m"]),
        "tempo_ms_at(date, s, e, bpm, 0.25, to, m)": kernels.ms_at(c["date"], c["s"], c["e"], c["bpm"], F.lit(0.25), c["to"], c["m"]),
        "elapsed_ms(bpm, bpm + i, coalesce(m, 0.5), date / 720)": kernels.elapsed_ms(c["bpm"], c["bpm"] + c["i"], F.coalesce(c["m"], F.lit(0.5)), c["date"] / 720),
        "spread_intensity(array(0D, i / 9, i / 3, 1D))": kernels.spread_intensity(F.array(F.lit(0.0), c["i"] / 9, c["i"] / 3, F.lit(1.0))),
        "rubato_removed(date % 2880, s, e, i, late, early)": kernels.rubato_removed(c["date"] % 2880, c["s"], c["e"], c["i"], c["late"], c["early"]),
        "tempo_date_at(date * 1.1D - 20, s, e, bpm, 0.25, to, m)": kernels.date_at(c["date"] * 1.1 - 20, c["s"], c["e"], c["bpm"], F.lit(0.25), c["to"], c["m"]),
        "volume_at(date, s, e, bpm, to, c, p)": kernels.eased(c["date"], c["s"], c["e"], c["bpm"], c["to"], c["c"], c["p"]),
    }
    for sql, column in pairs.items():
        got = [r[0] for r in spark.sql(f"SELECT {sql} FROM kernel_rows ORDER BY date").collect()]
        want = [r[0] for r in t.orderBy("date").select(column.cast("double")).collect()]
        assert got == pytest.approx(want, rel=1e-12), sql


ACCENTS = [(1.0, 0.5, 0.5, -0.25), (2.0, -0.25, -0.25, 1.0), (3.5, 1.0, 1.0, 0.0)]
ACCENT = "array<struct<beat:double,value:double,transition_from:double,transition_to:double>>"


def test_accents(spark):
    kernels.register(spark)
    rows = [(b, a) for b in (0.5, 1.0, 1.5, 2.0, 3.0, 3.5, 4.2, 5.0, 7.0) for a in (ACCENTS, ACCENTS[1:], [])]
    t = spark.createDataFrame(rows, f"b double, a {ACCENT}")
    t.createOrReplaceTempView("accent_rows")
    got = [r[0] for r in spark.sql("SELECT accentuation_at(b, a, 4D) FROM accent_rows").collect()]
    want = [r[0] for r in t.select(kernels.accentuation_at(F.col("b"), F.col("a"), F.lit(4.0))).collect()]
    assert got == pytest.approx(want) and len({round(x, 6) for x in got}) > 6
    last = spark.sql("SELECT b, size(a) AS n, x.accent_beat FROM accent_rows, LATERAL accent_at(b, a) AS x").collect()
    assert {(r["b"], r["n"], r["accent_beat"]) for r in last} == {(b, len(a), max(x[0] for x in a if x[0] <= b)) for b, a in rows if any(x[0] <= b for x in a)}


def test_frames_are_joined_laterally(spark):
    """Times to dates through the frame that holds them, as the columns do it."""
    kernels.register(spark)
    frames = [(0.0, 0.0, 2880.0, 60.0, 0.25, 120.0, 0.4), (2900.0, 2880.0, 5760.0, 120.0, 0.25, None, None), (5000.0, 5760.0, 8640.0, 90.0, 0.25, 45.0, 0.7)]
    kind = "array<struct<begin_ms:double,date:double,end_date:double,bpm:double,beat_length:double,transition_to:double,mean_tempo_at:double>>"
    t = spark.createDataFrame([(float(ms), frames) for ms in range(-500, 9000, 700)], f"ms double, f {kind}")
    t.createOrReplaceTempView("timed")
    sql = "SELECT ms, tempo_date_at(ms - x.begin_ms, x.date, x.end_date, x.bpm, x.beat_length, x.transition_to, x.mean_tempo_at) AS d, x.begin_ms FROM timed, LATERAL frame_at(ms, f) AS x"
    got = {r["ms"]: (r["begin_ms"], r["d"]) for r in spark.sql(sql).collect()}
    x = F.element_at(F.filter("f", lambda f: f.begin_ms <= F.col("ms")), -1)
    args = [F.col("x").getField(c) for c in ("date", "end_date", "bpm", "beat_length", "transition_to", "mean_tempo_at")]
    want = t.where("ms >= 0").withColumn("x", x).select("ms", "x.begin_ms", kernels.date_at(F.col("ms") - F.col("x.begin_ms"), *args).alias("d")).collect()
    assert got == {r["ms"]: (r["begin_ms"], pytest.approx(r["d"])) for r in want}


def test_optimized_elapsed(spark):
    kernels.register(spark)
    rows = [(80.0, b, 0.4, n, ms) for b in (80.2, 120.0, 50.0) for n in (0.0, 4.0) for ms in (0.0, 1500.0, 2400.0, 2600.0, 3900.0)]
    t = spark.createDataFrame(rows, "a double, b double, m double, n double, ms double")
    t.createOrReplaceTempView("segments")
    got = spark.sql("SELECT a, b, n, ms, x.* FROM segments, LATERAL optimized_elapsed(a, b, m, n, ms) AS x").collect()
    o = kernels.optimized_elapsed(*[F.col(c) for c in ("a", "b", "m", "n", "ms")])
    want = {tuple(r)[:4]: tuple(r)[4:] for r in t.select("a", "b", "n", "ms", o.alias("o")).select("a", "b", "n", "ms", "o.*").collect()}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[4:] == pytest.approx(want[tuple(r)[:4]])
