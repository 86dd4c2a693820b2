"""The tempo stage over many works at once, each a situation of its own: known curves, chains, silent onsets, tempos that were there before."""

import json

import numpy as np
import pytest

from tactuslab.model import META, PEDALS, State
from tactuslab.plans import calls

BEAT = 720
NOTE = "perf_id long, note_id string, seq long, part int, date long, duration long, midi_pitch int, onset double, midi_duration double, velocity double, source string, tick_date double, tick_duration double, abs_vel_change double"
CALL = "perf_id long, pos long, id string, name string, argumentation string, options string"
TEMPO = "perf_id long, scope int, id string, date double, bpm double, beat_length double, transition_to double, mean_tempo_at double"


def heard(curve, beats):
    """Onsets at every beat under a tempo curve over beats, by fine steps."""
    x = np.linspace(0, beats, beats * 400 + 1)
    pace = 60 / np.array([curve(v) for v in x])
    time = np.concatenate([[0], np.cumsum((pace[1:] + pace[:-1]) / 2 * np.diff(x))])
    return [(k * BEAT, float(time[k * 400])) for k in range(beats + 1)]


def power(a, b, beats, half=0.5, at=0):
    return lambda x: a + (b - a) * max(0.0, (x - at) / beats) ** (np.log(0.5) / np.log(half))


def fit(start, end, **more):
    return {"from": start * BEAT, "to": end * BEAT, "beatLength": 0.25, "silentOnsets": [], "scope": "global", **more}


BOTH = lambda n: [fit(0, n), fit(n, 2 * n, **{"continue": True})]
BOW = heard(lambda x: 80 + 10 * x if x <= 4 else 120 - 10 * (x - 4), 8)
VALLEY = heard(lambda x: power(120, 80, 6, 0.3)(x) if x <= 6 else power(80, 120, 6, 0.7, 6)(x), 12)
ARCH = [(k * BEAT, t) for k, t in enumerate((0.0, 0.80, 1.53, 2.19, 2.80, 3.43, 4.10, 4.84, 5.65))]
SLOW = [(k * BEAT, 2.0 * k) for k in range(9)]

#: By name: onsets, calls, tempos there before (beat, bpm, beat length).
WORKS = {
    "even": (heard(lambda x: 100, 4), [fit(0, 4)], []),
    "faster": (heard(power(80, 120, 4), 4), [fit(0, 4)], []),
    "slower": (heard(power(120, 80, 4), 4), [fit(0, 4)], []),
    "bent": (heard(power(80, 120, 8, 0.3), 8), [fit(0, 8)], []),
    "bow": (BOW, BOTH(4), []),
    "wide": (heard(power(60, 120, 8), 8), [fit(0, 8)], []),
    "long": (heard(power(80, 120, 16), 16), [fit(0, 16)], []),
    "valley": (VALLEY, BOTH(6), []),
    "arch": (ARCH, BOTH(4), []),
    "no notes": ([], [fit(0, 1)], [(0, 88.0, 0.25)]),
    "touching": ([(BEAT, 0.0), (2 * BEAT, 1.0)], [fit(1, 2)], [(0, 90.0, 0.25), (1, 91.0, 0.25), (2, 150.0, 0.25)]),
    "beyond": ([(0, 0.0), (BEAT, 1.0)], [fit(0, 1)], [(0, 50.0, 0.25), (0.5, 200.0, 0.25)]),
    "nothing before": (heard(lambda x: 100, 4), [fit(0, 4, **{"continue": True})], []),
    "silent": (SLOW, [fit(5, 8, silentOnsets=[{"date": 5040, "onset": 7.7}])], []),
    "other beats": (heard(lambda x: 100, 8), [fit(4, 8, **{"continue": True})], [(0, 60.0, 0.5)]),
}


@pytest.fixture(scope="module")
def fitted(spark):
    notes, rows, before = [], [], []
    for k, (onsets, chain, tempos) in enumerate(WORKS.values()):
        notes += [(k, f"n{i}", i, 1, d, BEAT, 67, t, 0.5, 100.0, None, None, None, None) for i, (d, t) in enumerate(onsets)]
        rows += [(k, i, f"c{k}-{i}", "ApproximateLogarithmicTempo", None, json.dumps(o)) for i, o in enumerate(chain)]
        before += [(k, None, f"old{i}", float(b * BEAT), bpm, beat, None, None) for i, (b, bpm, beat) in enumerate(tempos)]
    meta = spark.createDataFrame([(k, 4, 4) for k in range(len(WORKS))], META)
    state = State(spark.createDataFrame(notes, NOTE), spark.createDataFrame([], PEDALS), meta).inserted("tempo", spark.createDataFrame(before, TEMPO))
    out: dict = {name: [] for name in WORKS}
    for r in calls.run_calls(state, spark.createDataFrame(rows, CALL)).table("tempo").orderBy("date").collect():
        out[list(WORKS)[r["perf_id"]]].append(r)
    return out


def test_an_even_tempo_has_no_transition(fitted):
    for name in ("even", "nothing before"):
        (t,) = fitted[name]
        assert t["bpm"] == pytest.approx(100, abs=0.5) and (t["transition_to"] is None or name == "nothing before")


@pytest.mark.parametrize("name,a,b,near", [("faster", 80, 120, 3), ("slower", 120, 80, 3), ("wide", 60, 120, 3), ("long", 80, 120, 2)])
def test_even_changes_are_found_with_their_ends(fitted, name, a, b, near):
    (t,) = fitted[name]
    assert t["bpm"] == pytest.approx(a, abs=near) and t["transition_to"] == pytest.approx(b, abs=near) and 0.4 < t["mean_tempo_at"] < 0.6


def test_a_bent_change_keeps_its_direction(fitted):
    (t,) = fitted["bent"]
    assert 75 < t["bpm"] < 95 and 105 < t["transition_to"] < 125 and 0.1 < t["mean_tempo_at"] < 0.9


def test_shapes_stay_in_range(fitted):
    shapes = [t["mean_tempo_at"] for rows in fitted.values() for t in rows if t["mean_tempo_at"] is not None]
    assert len(shapes) > 8 and all(0.02 <= x <= 0.98 for x in shapes)


def test_chained_segments_are_fitted_together(fitted):
    """A bow is low, high, low, and rounded at its top."""
    a, b = fitted["bow"]
    assert a["transition_to"] == pytest.approx(b["bpm"])  # one boundary, one tempo
    assert (a["bpm"], a["transition_to"], b["bpm"], b["transition_to"]) == pytest.approx((80, 120, 120, 80), abs=4)
    assert a["mean_tempo_at"] < 0.5 < b["mean_tempo_at"]


def test_a_valley_is_rounded_evenly(fitted):
    a, b = fitted["valley"]
    assert a["mean_tempo_at"] < 0.5 < b["mean_tempo_at"] and 0.85 < a["mean_tempo_at"] + b["mean_tempo_at"] < 1.15
    assert a["transition_to"] == pytest.approx(b["bpm"], abs=2.5)


def test_directions_of_chained_segments_are_kept(fitted):
    a, b = fitted["arch"]
    assert a["transition_to"] > a["bpm"] and b["transition_to"] < b["bpm"]


def test_tempos_stay_where_nothing_is_fitted(fitted):
    assert [(t["date"], t["bpm"]) for t in fitted["no notes"]] == [(0, 88)]


def test_a_tempo_at_the_end_of_the_range_stays(fitted):
    at = {t["date"]: t["bpm"] for t in fitted["touching"]}
    assert set(at) == {0, BEAT, 2 * BEAT} and at[0] == 90 and at[2 * BEAT] == 150 and at[BEAT] == pytest.approx(60, abs=1)


def test_what_went_on_beyond_the_range_begins_anew(fitted):
    at = {t["date"]: t["bpm"] for t in fitted["beyond"]}
    assert set(at) == {0, BEAT} and at[BEAT] == 200


def test_silent_onsets_take_the_place_of_played_ones(fitted):
    """Taken from a much faster performance, one lets the line run below zero at the end."""
    (t,) = fitted["silent"]
    assert t["bpm"] < 0 or (t["transition_to"] is not None and t["transition_to"] < 0)


def test_a_chain_ends_at_another_beat_length(fitted):
    at = {(t["date"], t["beat_length"]) for t in fitted["other beats"]}
    assert at == {(0, 0.5), (4 * BEAT, 0.25)}
