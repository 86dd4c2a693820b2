"""Chains of three kinds of works in one pass against one run for each work."""

import json

import pytest
from pyspark.sql import functions as F

from tactuslab.model import State
from tactuslab.plans import calls, pipeline, projects, stages
from tactuslab.plans.registry import Registry
from tests.test_all_stages import nothing, played


def chains():
    """By work: long chains with many options, another with others, a short one, and none."""
    full = [
        stages.MakeChoice(prefer="a", velocity="b"), stages.Modify(change=2.0, start=0, end=720, scope=1), stages.Modify(aspect="onset", change=0.01, note_ids=("n3", "n4")),
        stages.InsertTemporalSpread(placement="on-beat", threshold_ms=30.0), stages.InsertDynamicsGradient(sort_velocities=True), stages.ApproximateLogarithmicTempo(start=0, end=5760, silent_onsets=((2880, 2.3),)),
        stages.ApproximateLogarithmicTempo(start=5760, end=10800, go_on=True), stages.TranslatePhysicalTimeToTicks(), stages.StylizeOrnamentation(tick_tolerance=40.0), stages.InsertRubato(start=720, length=720),
        stages.InsertRubato(start=0, length=720), stages.CombineAdjacentRubatos(intensity_tolerance=5.0, compression_tolerance=5.0), stages.InsertDynamicsInstructions(start=0, end=10800, phantom_velocities=((720, 70.0),)),
        stages.InsertMetricalAccentuation(pattern="p", start=0, end=2880, scale_tolerance=50.0), stages.InsertMetricalAccentuation(pattern="q", start=2880, end=5760, scale_tolerance=50.0, neutral_end=True),
        stages.MergeMetricalAccentuations(names=("p", "q"), into="both"), stages.InsertArticulation(note_ids=("n0", "n4", "n7"), aspects=("rel_dur", "rel_vel"), articulation="long"), stages.StylizeArticulation(volume_tolerance=0.2),
        stages.InsertPedal(duration=60.0, direction="up", depth=0.5), stages.InsertMetadata(authors=[{"number": 1, "text": "A"}], comments=["c"], app_info=[{"name": "x", "version": "1", "url": "u"}]),
        stages.InsertAsynchrony(part=0, start=0, end=2880), stages.MakeDefaultArticulation(), stages.CompressOrnamentation(precision=1),
    ]
    other = [
        stages.Modify(aspect="duration", change=0.1, start=1440, end=7200), stages.InsertTemporalSpread(placement="before-beat", threshold_ms=10.0), stages.InsertDynamicsGradient(gradient=(0.0, 1.0), date=720),
        stages.ApproximateLogarithmicTempo(start=0, end=10800, beat_length=0.5), stages.TranslatePhysicalTimeToTicks(translate_modifiers=False), stages.InsertRubato(start=0, length=1440),
        stages.InsertDynamicsInstructions(start=720, end=7200), stages.InsertMetricalAccentuation(pattern="r", start=720, end=3600), stages.InsertArticulation(note_ids=("n1",), aspects=("abs_dur",)),
        stages.InsertPedal(pedal="p1", start=-30.0, duration=10.0), stages.InsertMetadata(related_resources=[{"uri": "u", "type": "t"}]), stages.InsertAsynchrony(part=1, start=720, end=1440),
    ]
    short = [stages.MakeChoice(timing="a", start=0, end=720), stages.InsertTemporalSpread(placement="none"), stages.InsertTemporalSpread(date=1440, placement="estimate")]
    for k, chain in enumerate((full, other, short)):
        for i, s in enumerate(chain):
            s.id, s.argumentation = f"call{k}-{i}", ({"id": f"a{k}"} if i % 2 else None)
    return {0: full, 1: other, 2: short}


def written(spark, by_work, tmp_path):
    """The chains as project files, read back as a table of calls."""
    tmp_path.mkdir(exist_ok=True)
    for k, chain in by_work.items():
        (tmp_path / f"{k}.json").write_text(projects.export_work({"name": f"{k}"}, chain))
    return projects.work_calls(spark, f"file://{tmp_path}").withColumn("perf_id", F.col("work").cast("long")).drop("work", "created")


def rows_of(state: State):
    """All tables of a state, numbers rounded, metadata as what its JSON says."""

    def plain(v):
        if isinstance(v, float):
            return round(v, 5)
        if isinstance(v, str) and v[:1] in "{[\"":
            return plain(json.loads(v))
        if isinstance(v, dict):
            return sorted((k, plain(x)) for k, x in v.items())
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    out = {}
    for name, t in {"notes": state.notes, "pedals": state.pedals, **state.tables}.items():
        out[name] = sorted(repr([plain(r[c]) for c in sorted(t.columns)]) for r in t.collect())
    return {k: v for k, v in out.items() if v}


def test_one_pass_equals_a_run_for_each_work(spark, tmp_path):
    by_work = chains()
    start = played(spark, 4)
    start = start.with_notes(start.notes.withColumn("source", F.when(F.col("seq") % 5 == 0, "b").otherwise("a")))
    got = calls.run_calls(start, written(spark, by_work, tmp_path))
    want: dict = {}
    for k in range(4):
        own = State(*(t.where(F.col("perf_id") == k) for t in (start.notes, start.pedals, start.meta)))
        for name, rows in rows_of(pipeline.Pipeline(by_work.get(k, [])).run(own)).items():
            want.setdefault(name, []).extend(rows)
    assert rows_of(got) == {k: sorted(v) for k, v in want.items()}
    corresp = {(r["transformer_id"], r["corresp"][0]) for r in got.table("provenance").collect()}
    assert ("call0-3", "a0") in corresp and ("call1-3", "a1") in corresp and ("call0-10", "call0-10") in corresp


def test_empty_tables_and_unknown_names(spark):
    kind = "perf_id long, pos long, id string, name string, argumentation string, options string"
    rows = [(0, 0, "x", "NoSuchStage", None, None), (0, 1, "y", "Modify", None, '{"aspect": "velocity", "change": "no number", "from": 0}'), (0, 2, "z", "InsertTemporalSpread", None, None), (9, 0, "w", "Modify", "a", "not json")]
    table = spark.createDataFrame(rows, kind)
    out = calls.run_calls(nothing(spark), table)
    assert out.notes.count() == 0
    same = played(spark, 1)
    assert rows_of(calls.run_calls(same, table.where("perf_id = 9"))) == rows_of(same) == rows_of(calls.run_calls(same, table.limit(0)))
    modified = calls.typed_options(table.where("name = 'Modify'"), stages.Modify).orderBy("id").collect()
    assert [(r["change"], r["start"], r["end"], r["scope"], r["note_ids"]) for r in modified] == [(0.0, 0, 0, None, None)] * 2


def test_requirements_are_checked_for_each_work(spark):
    kind = "perf_id long, pos long, id string, name string, argumentation string, options string"
    table = spark.createDataFrame([(4, 0, "x", "InsertRubato", None, "{}"), (5, 0, "y", "TranslatePhyiscalTimeToTicks", None, "{}"), (5, 1, "z", "InsertRubato", None, "{}")], kind)
    with pytest.raises(ValueError, match="work 4 requires TranslatePhysicalTimeToTicks"):
        calls.run_calls(nothing(spark), table)
    calls.run_calls(nothing(spark), table.where("perf_id = 5"))


def test_order_of_equal_stages(spark):
    """Ranges order their own calls only; one without a range stays where it is, and dates of rubatos or pedals order nothing."""
    chain = [
        stages.InsertRubato(start=1440), stages.InsertRubato(start=0), stages.InsertPedal(start=5.0), stages.InsertPedal(start=-5.0), stages.Modify(start=2880, end=3600), stages.Modify(start=720, end=1440),
        stages.MakeChoice(start=1440, end=2000), stages.MakeChoice(prefer="x"), stages.MakeChoice(start=720, end=800), stages.MakeChoice(start=0, end=100),
    ]
    got = [(s.name, s.options["start"]) for s in stages.registry.sorted(chain)]
    assert got == [("MakeChoice", 1440), ("MakeChoice", None), ("MakeChoice", 0), ("MakeChoice", 720), ("Modify", 720), ("Modify", 2880), ("InsertRubato", 1440), ("InsertRubato", 0), ("InsertPedal", 5.0), ("InsertPedal", -5.0)]
    text = lambda s: json.dumps(projects.call_options(s))
    table = spark.createDataFrame([(1, k, f"c{k}", s.name, None, text(s)) for k, s in enumerate(chain)], "perf_id long, pos long, id string, name string, argumentation string, options string")
    assert [r["id"] for r in calls.steps(table).orderBy("place", "k").collect()] == [f"c{chain.index(s)}" for s in stages.registry.sorted(chain)]
    assert len(Registry().sorted(chain)) == len(chain)


def test_what_calls_created_is_written_back(spark, tmp_path):
    """Run, export, import: every call has the ids of what it inserted, and nothing else has changed."""
    by_work = {k: c[:4] if k < 2 else c for k, c in chains().items()}
    before = written(spark, by_work, tmp_path / "in")
    out = calls.run_calls(played(spark, 3), before)
    made = calls.created(out)
    calls.export_works(before, made).select("json").write.text(f"file://{tmp_path}/out")
    back = projects.work_calls(spark, f"file://{tmp_path}/out", multi_line=False).collect()
    ids = {}
    for r in out.table("provenance").collect():
        ids.setdefault((r["perf_id"], r["transformer_id"]), set()).add(r["instruction_id"])
    assert ids and {(int(r["work"]), r["id"]): set(r["created"]) for r in back if r["created"]} == ids
    same = lambda rows: sorted((r["id"], r["name"], r["argumentation"] or "", json.dumps(json.loads(r["options"]), sort_keys=True)) for r in rows)
    assert same(back) == same(before.collect())
    one = calls.export_works(before, made).where("perf_id = 1").collect()[0]["json"]
    work, chain = projects.import_work(one)
    assert work == {"name": "1"} and {s.id: set(s.created) for s in chain if s.created} == {i: x for (p, i), x in ids.items() if p == 1}
