"""Each stage class on a few notes and on empty tables, the whole chain, and the fits against plain searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactuslab.model import META, PEDALS, State
from tactuslab.operators import dynamics, tempo
from tactuslab.plans import pipeline, stages

KIND = "perf_id long, note_id string, seq long, part int, date long, duration long, midi_pitch int, onset double, midi_duration double, velocity double, source string, tick_date double, tick_duration double, abs_vel_change double"


def played(spark, performances=2, chords=16):
    """Chords of three notes, a beat each, a little spread, uneven and accented."""
    rng = np.random.default_rng(5)
    rows, pedals = [], []
    for p in range(performances):
        for c in range(chords):
            at = c * 0.5 + rng.normal(0, 0.02) + 0.3
            for k in range(3):
                seq = 3 * c + k
                rows.append((p, f"n{seq}", seq, 1 + k % 2, c * 720, 720, 60 + 4 * k + c % 5, at + k * 0.03, 0.4, 60.0 + 10 * (c % 4 == 0) + 3 * k, "a", None, None, None))
        pedals.append((p, 0, f"p{p}", "sustain", None, None, 0.5, 1.5, None, None, "a"))
    meta = [(p, 4, 4) for p in range(performances)]
    return State(spark.createDataFrame(rows, KIND), spark.createDataFrame(pedals, PEDALS), spark.createDataFrame(meta, META))


def nothing(spark):
    return State(spark.createDataFrame([], KIND), spark.createDataFrame([], PEDALS), spark.createDataFrame([], META))


CHAIN = (
    stages.MakeChoice(prefer="a"), stages.Modify(change=2.0, start=0, end=720), stages.InsertTemporalSpread(), stages.InsertDynamicsGradient(), stages.ApproximateLogarithmicTempo(start=0, end=10800),
    stages.TranslatePhysicalTimeToTicks(), stages.StylizeOrnamentation(tick_tolerance=40.0), stages.InsertRubato(start=0, length=720), stages.InsertRubato(start=720, length=720), stages.CombineAdjacentRubatos(),
    stages.InsertDynamicsInstructions(start=0, end=10800), stages.InsertMetricalAccentuation(pattern="p", start=0, end=2880, scale_tolerance=50.0), stages.InsertMetricalAccentuation(pattern="q", start=2880, end=5760, scale_tolerance=50.0),
    stages.MergeMetricalAccentuations(names=("p", "q"), into="both"), stages.InsertArticulation(note_ids=("n0", "n4", "n7"), aspects=("rel_dur",)), stages.StylizeArticulation(), stages.InsertPedal(duration=60.0),
    stages.InsertMetadata(authors=["A"]), stages.InsertAsynchrony(part=1, start=0, end=2880), stages.MakeDefaultArticulation(), stages.CompressOrnamentation(), stages.InterpolateTimingImprecision(),
)


def test_the_chain_has_every_registered_stage():
    assert {s.name for s in CHAIN} == set(stages.registry.order())


def test_the_whole_chain(spark):
    out = pipeline.Pipeline(CHAIN).run(played(spark))
    assert out.notes.count() == 96 and out.notes.where("tick_date IS NULL OR tick_duration IS NULL").count() == 0
    n = {k: t.count() for k, t in out.tables.items()}
    assert all(n[k] > 0 for k in ("tempo", "ornament", "rubato", "dynamics", "accentuation_pattern", "articulation", "movement", "metadata", "definitions", "styles", "provenance"))
    assert {r["name"] for r in out.table("definitions").where("def_type = 'accentuationPatternDef'").collect()} >= {"both"}
    assert {r["name_ref"] for r in out.table("accentuation_pattern").collect()} <= {"both", "neutral"}
    tempos = out.table("tempo").orderBy("perf_id", "date").collect()
    assert [r["bpm"] for r in tempos] == pytest.approx([120] * len(tempos), abs=8)
    for kind in ("tempo", "rubato", "dynamics", "articulation"):
        rows = out.table(kind)
        assert rows.select("perf_id", "id").distinct().count() == rows.count()


@pytest.mark.parametrize("stage", CHAIN, ids=lambda s: s.name)
def test_stages_pass_empty_tables_through(spark, stage):
    out = stage.run(nothing(spark))
    assert out.notes.count() == 0 and all(t.count() == 0 for t in out.tables.values())


def test_articulations_of_a_date_are_clustered(spark):
    st = played(spark, 1)
    st = st.with_notes(st.notes.withColumn("tick_date", F.col("date").cast("double")).withColumn("tick_duration", F.lit(360.0)))
    kind = "perf_id long, id string, date double, noteid array<string>, rel_dur double, rel_vel double"
    rows = [(0, f"a{k}", float(k * 720), None, 0.5 + k * 0.01, 1.0) for k in range(3)] + [(0, "gone", 9000.0, ["#none"], 0.52, 1.0), (0, "far", 0.0, ["#n0"], 3.0, 1.0), (0, "near", 0.0, ["#n1"], 3.05, 1.0)]
    out = stages.StylizeArticulation().run(st.inserted("articulation", spark.createDataFrame(rows, kind)))
    defs = {r["name"]: r["body"] for r in out.table("definitions").collect()}
    assert set(defs) == {"def_0", "def_1"} and '"rel_dur":0.5125' in defs["def_0"]
    left = {r["id"]: (r["name_ref"], r["rel_dur"]) for r in out.table("articulation").collect()}
    # Three times as long, notes of a pitch that comes again would run into it: those keep their values. The largest cluster is the default.
    assert "gone" not in left and not {"a0", "a1", "a2"} & set(left) and set(left) == {"far", "near"}
    assert {s["default_articulation"] for s in out.table("styles").collect()} == {"def_0"}


def test_ids_are_numbered_by_what_rows_hold(spark):
    rows = spark.createDataFrame([(1, 0.0, "b", 5), (1, 0.0, "a", 9), (1, 720.0, "c", 1)], "perf_id long, date double, x string, seq long")
    ids = lambda r: {x["x"]: x["id"] for x in stages.with_ids(r, "k").collect()}
    assert ids(rows) == {"b": "k_0", "a": "k_0_1", "c": "k_720"}
    assert ids(rows.drop("seq")) == ids(rows.drop("seq").orderBy(F.desc("x"))) == {"a": "k_0", "b": "k_0_1", "c": "k_720"}


def test_the_fit_takes_what_the_operators_give(spark):
    """boundary_times, regression, partitioned and mean_tempo against the arrays that the fit works with."""
    n = played(spark, 1).notes
    marks = [0, 3600, 7200, 10800]
    pairs = tempo.onset_pairs(n)
    rows = pairs.orderBy("date").collect()
    dates, onsets = np.array([r["date"] for r in rows], float), np.array([r["onset"] for r in rows])
    got = [r["onset"] for r in tempo.boundary_times(n, marks).orderBy("boundary").collect()]
    assert got == pytest.approx(np.interp(marks, dates, onsets))
    points = tempo.partitioned(tempo.tempo_points(pairs), marks)
    lines = {r["segment"]: r for r in tempo.regression(points, 720.0, "segment").collect()}
    for k, g in points.toPandas().groupby("segment"):
        a, b = tempo._line(g["mid"].to_numpy() / 720, g["bpm"].to_numpy(), g["weight"].to_numpy())
        assert (lines[k]["intercept"], lines[k]["slope"]) == pytest.approx((a, b))
        assert k == int(np.clip(np.searchsorted(marks, g["mid"].iloc[0], "right") - 1, 0, 2))
    still = tempo.fit_chain(dates, onsets * 1000 * 1e6, marks, 0.25)  # no plausible tempo anywhere
    mean = tempo.mean_tempo(n.withColumn("onset", F.col("onset") * 1e6)).collect()[0]["bpm"]
    assert [x["bpm"] for x in still] == pytest.approx([mean] * 3)


def test_dynamics_against_a_plain_search():
    rng = np.random.default_rng(3)
    grid = [(c, p) for c in np.linspace(0, 1, 41) for p in np.linspace(-1, 1, 81)]
    cc, pp = (np.array(x) for x in zip(*grid, strict=True))
    for _ in range(12):
        dates = np.sort(rng.choice(np.arange(0, 7200, 360), 8, replace=False)).astype(float)
        v = rng.uniform(30, 100, 8)
        best = np.abs(dynamics._volumes(dates, dates[0], dates[-1], v[0], v[-1], cc, pp) - v).sum(1).min()
        f = dynamics.fit_curve(dates, v)
        own = np.abs(dynamics._volumes(dates, dates[0], dates[-1], v[0], v[-1], np.array([f["curvature"]]), np.array([f["protraction"]]))[0] - v).sum()
        assert own <= best * 1.03 + 0.5


def test_shapes_against_a_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(20):
        left, right, beats = rng.uniform(50, 150), rng.uniform(50, 150), rng.uniform(2, 12)
        x = np.sort(rng.uniform(0.02, 1, 9))
        ms = np.interp(x, tempo._GRID, tempo._elapsed(left, right, tempo._basis(tempo._GRID, rng.uniform(0.1, 0.9))[None], beats)[0]) + rng.normal(0, 20, 9)
        error = lambda s: float(np.sum((np.interp(x, tempo._GRID, tempo._elapsed(left, right, tempo._basis(tempo._GRID, s)[None], beats)[0]) - ms) ** 2))  # noqa: B023, E731
        assert error(tempo._best_shape(x, ms, left, right, beats)) <= min(error(s) for s in np.linspace(0.02, 0.98, 400)) * (1 + 1e-6) + 1e-6
