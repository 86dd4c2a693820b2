import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tactuslab.functions import kernels
from tactuslab.operators import dynamics, tempo

BEAT = 720


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_elapsed_time_of_an_even_acceleration(spark):
    got = value(spark, kernels.elapsed_ms(F.lit(80.0), F.lit(120.0), F.lit(0.5), F.lit(4.0)))
    assert got == pytest.approx(2432.792, abs=1e-3)


def test_intensity_of_even_and_bent_onsets(spark):
    even = F.array(*[F.lit(k / 4) for k in range(5)])
    bent = F.array(*[F.lit((k / 4) ** 2.5) for k in range(5)])
    assert value(spark, kernels.spread_intensity(even)) == pytest.approx(1, abs=1e-4)
    assert value(spark, kernels.spread_intensity(bent)) == pytest.approx(2.5, abs=1e-4)
    assert value(spark, kernels.spread_intensity(F.array(F.lit(0.0), F.lit(1.0)))) == 1


def test_optimizing_elapsed_time_meets_the_target_or_scales(spark):
    o = lambda target: value(spark, kernels.optimized_elapsed(F.lit(80.0), F.lit(120.0), F.lit(0.5), F.lit(4.0), F.lit(target)))
    met = o(2500.0)
    assert not met["bpm_scaled"] and met["start_bpm"] == 80
    assert value(spark, kernels.elapsed_ms(F.lit(80.0), F.lit(120.0), F.lit(met["mean_tempo_at"]), F.lit(4.0))) == pytest.approx(2500, abs=0.2)
    assert o(9000.0)["bpm_scaled"]


def test_date_inverts_milliseconds(spark):
    args = [F.lit(float(x)) for x in (0, 2880, 60, 0.25, 120, 0.3)]
    for d in (0.0, 100.0, 1440.0, 2880.0):
        ms = kernels.ms_at(F.lit(d), *args)
        assert value(spark, kernels.date_at(ms, *args)) == pytest.approx(d, abs=4)


def test_accents(spark):
    accent = lambda b, v, t: F.struct(F.lit(b).alias("beat"), F.lit(v).alias("value"), F.lit(v).alias("transition_from"), F.lit(t).alias("transition_to"))
    pattern = F.array(accent(1.0, 1.0, 0.0), accent(3.0, 0.5, 0.25))
    at = lambda b: value(spark, kernels.accentuation_at(F.lit(b), pattern, F.lit(4.0)))
    assert [at(x) for x in (0.5, 1.0, 2.0, 3.0, 4.0, 5.0)] == [0, 1, 0.5, 0.5, 0.375, 0.25]


def onsets(tempo_at, beats):
    """Dates of beats and when they sound at a tempo by date."""
    dates, at, out = [], 0.0, []
    for k in range(beats + 1):
        dates.append(k * BEAT)
        out.append(at * 1000)
        d = np.linspace(k * BEAT, (k + 1) * BEAT, 101)
        t = np.array([tempo_at(x) for x in d])
        at += float(np.sum((1 / t[1:] + 1 / t[:-1]) / 2) / 100) * 60
    return np.array(dates), np.array(out)


def curve(a, b, shape, end):
    p = math.log(0.5) / math.log(shape)
    return lambda d: a + (b - a) * (min(max(d / end, 0), 1)) ** p


@pytest.mark.parametrize(("a", "b", "shape", "beats", "near"), [(80, 120, 0.5, 4, 5), (120, 80, 0.5, 8, 4), (60, 120, 0.5, 8, 3), (80, 120, 0.5, 16, 2), (80, 120, 0.3, 8, 15)])
def test_fit_finds_a_curve(a, b, shape, beats, near):
    found = tempo.fit_chain(*onsets(curve(a, b, shape, beats * BEAT), beats), [0, beats * BEAT], 0.25)
    assert len(found) == 1
    assert abs(found[0]["bpm"] - a) < near and abs(found[0]["transition_to"] - b) < near
    assert (found[0]["transition_to"] > found[0]["bpm"]) == (b > a)
    assert 0.1 < found[0]["mean_tempo_at"] < 0.9


def test_fit_of_a_bow_has_a_rounded_top():
    n = 4 * BEAT
    found = tempo.fit_chain(*onsets(lambda d: 80 + 40 * (d / n if d <= n else 2 - d / n), 8), [0, n, 2 * n], 0.25)
    assert [round(x["bpm"] / 40) for x in found] == [2, 3] and abs(found[0]["transition_to"] - 120) < 5
    assert found[0]["mean_tempo_at"] < 0.5 < found[1]["mean_tempo_at"]


def test_fit_of_one_tempo_has_no_transition_worth_the_name():
    found = tempo.fit_chain(*onsets(lambda d: 100, 8), [0, 8 * BEAT], 0.25)
    assert found[0]["bpm"] == pytest.approx(100, abs=0.5)
    assert found[0]["transition_to"] is None or found[0]["transition_to"] == pytest.approx(100, abs=0.5)


def test_fit_without_data():
    assert tempo.fit_chain(np.array([0]), np.array([0.0]), [0, 720], 0.25) == []
    same = tempo.fit_chain(np.array([0, 720]), np.array([0.0, 20000.0]), [0, 720], 0.25)
    assert same[0]["bpm"] == pytest.approx(3) and same[0]["transition_to"] is None


@settings(max_examples=20, deadline=None)
@given(st.floats(0, 1), st.floats(-0.9, 0.9))
def test_dynamics_curve_is_found_again(curvature, protraction):
    dates = np.arange(0, 2881, 360)
    made = dynamics._volumes(dates.astype(float), 0, 2880, 40, 90, np.array([curvature]), np.array([protraction]))[0]
    got = dynamics.fit_curve(dates, made)
    back = dynamics._volumes(dates.astype(float), 0, 2880, 40, 90, np.array([got["curvature"]]), np.array([got["protraction"]]))[0]
    assert np.abs(back - made).sum() < 12


def test_dynamics_of_few_points():
    assert dynamics.fit_curve(np.array([]), np.array([])) is None
    assert dynamics.fit_curve(np.array([5]), np.array([60.0]))["transition_to"] is None
    assert dynamics.fit_curve(np.array([5, 9]), np.array([60.0, 70.0]))["curvature"] == 0.5
