"""Stages on a few notes, chains, project files, score files and the stream."""

import pytest
from pyspark.sql import functions as F

from tactuslab.model import META, PEDALS, State
from tactuslab.operators import notes as ops
from tactuslab.operators import relops, rubato, ticks
from tactuslab.plans import pipeline, stages
from tactuslab.plans.registry import Registry, validate
from tactuslab.sources import msm

KIND = "perf_id long, note_id string, seq long, part int, date long, duration long, midi_pitch int, onset double, midi_duration double, velocity double, source string, tick_date double, tick_duration double, abs_vel_change double"


def notes(spark, *rows):
    """Rows of date, onset, midi duration, velocity, pitch."""
    full = [(1, f"n{k}", k, 1, d, 720, p, o, md, v, None, None, None, None) for k, (d, o, md, v, p) in enumerate(rows)]
    return spark.createDataFrame(full, KIND)


def state(spark, *rows):
    return State(notes(spark, *rows), spark.createDataFrame([], PEDALS), spark.createDataFrame([(1, 4, 4)], META))


def tempos(spark, *rows):
    return spark.createDataFrame([(1, None, f"t{k}", float(d), bpm, 0.25, to, m) for k, (d, bpm, to, m) in enumerate(rows)], "perf_id long, scope int, id string, date double, bpm double, beat_length double, transition_to double, mean_tempo_at double")


def test_ticks_at_sixty(spark):
    n = notes(spark, (0, 0.0, 1.0, 60.0, 60), (1440, 2.0, 1.0, 60.0, 60), (2160, 3.0, 1.0, 60.0, 60))
    out = ticks.tick_onsets(n, tempos(spark, (0, 60.0, None, None))).orderBy("date").collect()
    assert [r["tick_date"] for r in out] == [0, 1440, 2160]


def test_spread_of_two_notes(spark):
    s = stages.InsertTemporalSpread().run(state(spark, (0, 0.5, 1.0, 60.0, 60), (0, 1.5, 1.0, 70.0, 62)))
    o = s.table("ornament").collect()[0]
    assert (o["frame_start"], o["frame_length"], o["noteoff_shift"], o["note_order"], o["id"]) == (-500, 1000, "monophonic", "ascending pitch", "ornament_0")
    assert {r["onset"] for r in s.notes.collect()} == {1.0}
    p = s.table("provenance").collect()
    assert [r["instruction_id"] for r in p] == ["ornament_0"]


def test_gradient_of_two_notes(spark):
    s = stages.InsertDynamicsGradient().run(state(spark, (0, 0.0, 1.0, 50.0, 60), (0, 0.1, 1.0, 100.0, 62)))
    o = s.table("ornament").collect()[0]
    assert (o["transition_from"], o["transition_to"], o["scale"]) == (-1, 0, 50)
    assert {r["velocity"] for r in s.notes.collect()} == {100.0}


def test_articulation_and_its_undoing(spark):
    st = state(spark, (0, 0.0, 1.0, 60.0, 60), (720, 1.0, 1.0, 60.0, 60))
    st = st.with_notes(st.notes.withColumn("tick_duration", F.when(F.col("date") == 0, 360.0).otherwise(1440.0)))
    out = stages.InsertArticulation(note_ids=["n0", "n1"], aspects=["rel_dur"]).run(st)
    assert '"rel_dur":1.25' in out.table("definitions").collect()[0]["body"]
    assert sorted(r["tick_duration"] for r in out.notes.collect()) == [288, 1152]
    assert sorted(r["noteid"][0] for r in out.table("articulation").collect()) == ["#n0", "#n1"]


def test_rubatos_join_into_a_loop_that_ends(spark):
    kind = "perf_id long, date double, frame_length double, intensity double, late_start double, early_end double"
    rows = [(1, 0.0, 720.0, 0.8, None, None), (1, 720.0, 720.0, 0.9, None, None), (1, 1440.0, 720.0, 1.5, None, None)]
    last = spark.createDataFrame([(1, 5000)], "perf_id long, last_date long")
    out = rubato.combined(spark.createDataFrame(rows, kind), last).orderBy("date").collect()
    assert [(r["date"], r["loop"]) for r in out] == [(0, True), (1440, False)]
    assert out[0]["intensity"] == pytest.approx(0.85)
    out = rubato.combined(spark.createDataFrame(rows[:2], kind), last).orderBy("date").collect()
    assert [(r["date"], r["intensity"]) for r in out][1] == (1440, None)


def test_clusters_of_a_box(spark):
    rows = [(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (0.9, 0.5), (1.8, 0.9), (9.0, 9.0), (float("nan"), 0.0), (0.1, 5.0)])]
    out = relops.cluster(spark.createDataFrame(rows, "perf_id long, index int, x double, y double"), {"x": 1.0, "y": 1.0})
    assert {r["index"]: r["label"] for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1}


def test_choice_keeps_one_take(spark):
    n = notes(spark, (0, 0.0, 1.0, 10.0, 60), (0, 0.1, 1.0, 20.0, 60), (0, 0.2, 1.0, 30.0, 61)).withColumn("source", F.when(F.col("seq") == 0, "a").otherwise("b"))
    out = ops.make_choice(n, "a", "b").orderBy("note_id").collect()
    assert [(r["note_id"], r["velocity"]) for r in out] == [("n0", 20), ("n2", 30)]


def test_registry_places_checks_and_validates():
    class Alpha(stages.Stage):
        name = "Alpha"

    class Beta(stages.Stage):
        name = "Beta"
        requires = ("Alpha",)

    class Own(stages.Stage):
        name = "Own"

    r = Registry()
    r.register(Alpha)
    r.register(Beta)
    r.register(Own, after="Alpha")
    r.register(Own)
    assert r.order() == ["Alpha", "Own", "Beta"]
    with pytest.raises(KeyError):
        r.register(type("Other", (stages.Stage,), {"name": "Other"}), before="Nothing")
    assert "Other" not in r and r.create("Nothing") is None
    assert [s.name for s in r.sorted([Beta(), Alpha()])] == ["Alpha", "Beta"]
    assert validate([Beta(), Alpha()])[0].index == 0 and not validate([Alpha(), Beta()])


def test_project_survives_the_round_trip(caplog):
    chain = [stages.Modify(argumentation={"id": "x", "conclusion": {"certainty": "likely"}}, change=2.0), stages.MakeChoice(argumentation={"id": "x"}, prefer="take 1")]
    text = pipeline.export_work({"name": "piece", "mpm": "p", "mei": "m"}, chain)
    work, back = pipeline.import_work(text)
    assert work == {"name": "piece", "mpm": "p", "mei": "m"}
    assert [s.name for s in back] == ["MakeChoice", "Modify"] and back[1].options["change"] == 2.0
    assert '"incorporates": ["take 1"]' in text
    _, rest = pipeline.import_work(text.replace('"Modify"', '"Strange"'))
    assert len(rest) == 1 and "Strange" in caplog.text


def test_tempo_fit_replaces_and_restores(spark):
    rows = [(k * 720, k * 0.5, 0.4, 60.0, 60) for k in range(9)]
    st = state(spark, *rows).with_table("tempo", tempos(spark, (0, 60.0, None, None)))
    out = stages.ApproximateLogarithmicTempo(start=0, end=2880).run(st).table("tempo").orderBy("date").collect()
    assert [r["date"] for r in out] == [0, 2880]
    assert out[0]["bpm"] == pytest.approx(120, abs=0.5) and out[1]["bpm"] == 60


def test_score_files(spark, tmp_path):
    n = notes(spark, (0, 0.0, 1.0, 60.0, 60), (720, 1.0, 1.0, 61.0, 62)).withColumn("note_id", F.concat(F.lit('a&"'), "note_id"))
    xml = msm.to_xml(n, spark.createDataFrame([(1, 3, 4)], META), intermediate=True).collect()[0]["xml"]
    (tmp_path / "a.msm").write_text(xml)
    back = msm.read_notes(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["note_id"], r["date"], r["midi_pitch"], r["onset"], r["velocity"]) for r in back] == [('a&"n0', 0, 60, 0.0, 60.0), ('a&"n1', 720, 62, 1.0, 61.0)]
    assert [tuple(r)[1:] for r in msm.read_time_signatures(spark, str(tmp_path)).collect()] == [(3, 4)]


def test_empty_performances_pass_through(spark):
    st = state(spark)
    for stage in (stages.Modify(), stages.InsertTemporalSpread(), stages.InsertDynamicsGradient(), stages.InsertAsynchrony(), stages.MakeChoice(prefer="a")):
        assert stage.run(st).notes.count() == 0


def test_stream_of_chords(spark, tmp_path):
    from tactuslab.streaming import chords

    src = spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT), 0, 0) AS ts, id % 2 AS user_id, 'view' AS event_type, CAST(id AS DOUBLE) AS value FROM range(48)")
    src.write.parquet(str(tmp_path / "in"))
    q = chords.stream_chords(chords.read_events(spark, str(tmp_path / "in"), 100)).writeStream.format("memory").queryName("chords").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("chords").agg(F.sum("n_notes")).collect()[0][0] == 48
