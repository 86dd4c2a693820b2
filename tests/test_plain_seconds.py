"""At a quarter a second ticks are 720 times the onset to the last digit."""

from tactuslab.operators import ticks


def test_no_digit_is_lost(spark):
    onsets = [k * 1e-6 / 43.2 * 1009 for k in range(1, 3000)]
    assert any(x * 1000 / 1000.0 != x for x in onsets)
    notes = spark.createDataFrame([(1, str(k), k, 1, 0, 720, 60, x, 0.5, 60.0) for k, x in enumerate(onsets)], "perf_id long, note_id string, seq long, part int, date long, duration long, midi_pitch int, onset double, midi_duration double, velocity double")
    tempos = spark.createDataFrame([(1, None, "t", 0.0, 60.0, 0.25, None, None)], "perf_id long, scope int, id string, date double, bpm double, beat_length double, transition_to double, mean_tempo_at double")
    got = ticks.tick_onsets(notes, tempos).select("onset", "tick_date").collect()
    assert len(got) == len(onsets) and all(x.tick_date == x.onset * 720 for x in got)
