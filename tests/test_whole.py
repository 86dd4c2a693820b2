"""Queries over whole tables, where the SQL of a registered query keeps a part."""

import os

import pytest

from tactuslab.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def elapsed(a, b, im, beats=4.0, steps=200):
    from math import log

    if abs(a - b) < 0.01:
        return beats * 60000 / a
    p = log(0.5) / log(im)
    ms = [60000 / (a + (b - a) * (i / steps) ** p) for i in range(steps + 1)]
    return sum((x + y) / 2 for x, y in zip(ms, ms[1:], strict=False)) * beats / steps


def test_optimize_elapsed_of_all_notes(spark):
    from tactuslab.sources import derived

    got = {r["note_id"]: r for r in QUERIES["optimize_elapsed_whole"](spark, DATA).collect()}
    notes = derived.notes(spark, DATA).collect()
    assert len(notes) > 400 and set(got) == {n["note_id"] for n in notes}
    assert "note_id < 400" not in ORACLES["optimize_elapsed_whole"]
    for n in notes:
        a, b, im, target = 60.0 + n["midi_pitch"], 60.0 + n["velocity"], 0.2 + n["note_id"] % 7 * 0.1, 2000.0 + n["note_id"] % 11 * 100
        ends = sorted(elapsed(a, b, m) for m in (0.02, 0.98))
        if abs(a - b) < 0.5:
            scaled, start = abs(240000 / target - (a + b) / 2) > 0.5, 240000 / target
        else:
            scaled = not ends[0] <= target <= ends[1]
            start = a * elapsed(a, b, im) / target if scaled else a
        r = got[n["note_id"]]
        assert r["bpm_scaled"] == scaled and abs(r["start_u"] / 1000 - start) < 0.001


def test_mean_tempo_is_fitted_over_whole_performances(spark):
    from math import log

    from tactuslab.sources import derived

    got = {r["perf_id"]: r["mean_percent"] for r in QUERIES["fit_mean_tempo_at_whole"](spark, DATA).collect()}
    assert "date <= 14400" not in ORACLES["fit_mean_tempo_at_whole"]
    heads, last = {}, {}
    for n in sorted(derived.notes(spark, DATA).collect(), key=lambda n: -n["seq"]):
        heads.setdefault(n["perf_id"], {})[n["date"]] = n["onset"]
        last[n["perf_id"]] = max(last.get(n["perf_id"], 0), n["date"])
    assert min(last.values()) > 14400 and set(got) == set(heads)
    for perf, dates in heads.items():
        p = sorted(dates.items())
        steps = [(o1, 60000 * (d1 - d0) / ((o1 - o0) * 1000 * 720)) for (d0, o0), (d1, o1) in zip(p, p[1:], strict=False) if o1 > o0]
        (s0, b0), (s1, b1) = steps[0], steps[-1]
        inner = [((s - s0) / (s1 - s0), v) for s, v in steps]
        inner = [(x, v) for x, v in inner if 0.01 < x < 0.99]
        error = {i: sum((b0 + (b1 - b0) * x ** (log(0.5) / log(i / 100)) - v) ** 2 for x, v in inner) for i in range(2, 99)}
        assert error[got[perf]] <= min(error.values()) * (1 + 1e-9)


def test_all_notes_are_shifted(spark):
    from tactuslab.sources import derived

    assert "seq % 3" not in ORACLES["shift_first_onset_whole"]
    got = {(r["kind"], r["id"]): (r["onset_u"], r["midi_duration_u"]) for r in QUERIES["shift_first_onset_whole"](spark, DATA).collect()}
    notes, first = derived.notes(spark, DATA).collect(), {}
    for n in notes:
        first[n["perf_id"]] = min(n["onset"], first.get(n["perf_id"], n["onset"]))
    assert {i for kind, i in got if kind == "note"} == {n["note_id"] for n in notes}
    for n in notes:
        assert abs(got["note", n["note_id"]][0] / 1e6 - (n["onset"] - first[n["perf_id"]])) < 1e-6


def test_pedals_before_the_first_note_are_cut(spark):
    from tactuslab.queries.core import _shifted

    notes = spark.createDataFrame([(1, 0, 2.0, 1.0), (1, 1, 3.0, 1.0)], "perf_id long, note_id long, onset double, midi_duration double")
    pedals = spark.createDataFrame([(1, 7, 1.5, 2.0), (1, 8, 2.5, 1.0), (2, 9, 1.0, 1.0)], "perf_id long, pedal_id long, onset double, midi_duration double")
    got = {(r["kind"], r["id"]): (r["onset_u"], r["midi_duration_u"]) for r in _shifted(notes, pedals).collect()}
    assert got == {("note", 0): (0, 1_000_000), ("note", 1): (1_000_000, 1_000_000), ("pedal", 7): (0, 1_500_000), ("pedal", 8): (500_000, 1_000_000), ("pedal", 9): (1_000_000, 1_000_000)}


def test_clusters_of_equal_velocity_are_whole(spark):
    from tactuslab.queries.stages import _indexed
    from tactuslab.sources import derived

    assert "% 4" not in ORACLES["dbscan_1d_whole"].split("idx AS", 1)[1]
    got = {(r["perf_id"], r["index"]): r["label"] for r in QUERIES["dbscan_1d_whole"](spark, DATA).collect()}
    same = {}
    for r in _indexed(derived.notes(spark, DATA)).collect():
        same.setdefault((r["perf_id"], r["velocity"]), []).append(r["index"])
    assert len(got) == sum(map(len, same.values()))
    labels = [(perf, {got[perf, i] for i in members}, len(members)) for (perf, _), members in same.items()]
    assert all(len(x) == 1 and (x == {-1}) == (n == 1) for _, x, n in labels)
    several = [(perf, min(x)) for perf, x, n in labels if n > 1]
    assert len(several) == len(set(several)) > 0
