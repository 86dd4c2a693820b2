"""Performance documents: a small one by hand, and a chain's tables written and read again."""

import json

import pytest
from pyspark.sql import functions as F

from tactuslab.model import INSTRUCTIONS
from tactuslab.plans import pipeline
from tactuslab.sources import performances
from tests.test_all_stages import CHAIN, played

DOCUMENT = """<?xml version="1.0" encoding="UTF-8"?>
<mpm xmlns="http://www.cemfi.de/mpm/ns/1.0">
  <metadata><author>A</author><author number="2">B &amp; C</author><comment>made from a score</comment>
    <relatedResources><resource uri="C:\\a b.mei" type="mei"/><resource uri="x.msm" type="msm"/></relatedResources></metadata>
  <performance name="one" pulsesPerQuarter="720">
    <global><header/><dated><tempoMap><tempo date="0.0" bpm="60.0" beatLength="0.25"/></tempoMap></dated></global>
    <part name="" number="1" midi.channel="0" midi.port="0" xml:id="s1">
      <header><articulationStyles><styleDef name="s"><articulationDef name="short" relativeDuration="0.5"/></styleDef></articulationStyles></header>
      <dated>
        <articulationMap><style date="0.0" name.ref="s" defaultArticulation="short"/><articulation date="720.0" relativeDuration="1.5" noteid="#a #b" corresp="c1 c2" xml:id="i"/><articulation date="1440.0" relativeDuration="0.5"/></articulationMap>
        <rubatoMap><rubato date="0.0" frameLength="1440.0" intensity="0.5" loop="true"/></rubatoMap>
      </dated>
    </part>
    <part name="" number="2" midi.channel="1" midi.port="0"><header/><dated><rubatoMap/></dated></part>
  </performance>
  <performance name="7" pulsesPerQuarter="720"><global><dated><tempoMap><tempo date="720" bpm="80" beatLength="0.5" transition.to="90" meanTempoAt="0.4"/></tempoMap></dated></global></performance>
</mpm>"""


def test_a_document_is_read(spark, tmp_path):
    (tmp_path / "a.mpm").write_text(DOCUMENT)
    s = performances.read(spark, f"file://{tmp_path}")
    rows = {k: [r.asDict() for r in t.collect()] for k, t in s.tables.items()}
    tempos = {r["bpm"]: r for r in rows["tempo"]}
    assert set(tempos) == {60.0, 80.0} and tempos[80.0]["perf_id"] == 7 and tempos[60.0]["perf_id"] != 7
    assert (tempos[80.0]["date"], tempos[80.0]["transition_to"], tempos[80.0]["mean_tempo_at"], tempos[80.0]["scope"]) == (720.0, 90.0, 0.4, None)
    a = sorted(rows["articulation"], key=lambda r: r["date"])
    assert [(r["scope"], r["date"], r["rel_dur"], r["noteid"], r["id"]) for r in a] == [(0, 720.0, 1.5, ["#a", "#b"], "i"), (0, 1440.0, 0.5, None, None)]
    assert [(r["instruction_id"], r["corresp"]) for r in rows["provenance"]] == [("i", ["c1", "c2"])]
    assert [(r["scope"], r["frame_length"], r["intensity"], r["loop"]) for r in rows["rubato"]] == [(0, 1440.0, 0.5, True)]
    assert [(r["map_type"], r["name_ref"], r["default_articulation"]) for r in rows["styles"]] == [("articulation", "s", "short")]
    assert [(r["def_type"], r["name"], json.loads(r["body"])) for r in rows["definitions"]] == [("articulationDef", "short", {"rel_dur": 0.5})]
    meta = [(r["pos"], r["kind"], json.loads(r["body"])) for r in rows["metadata"] if r["perf_id"] == 7]
    assert meta == [(0, "author", "A"), (1, "author", {"number": 2, "text": "B & C"}), (2, "comment", "made from a score"), (3, "relatedResource", {"type": "mei", "uri": "C:\\a b.mei"}), (4, "relatedResource", {"type": "msm", "uri": "x.msm"})]
    assert all(not rows[k] for k in INSTRUCTIONS if k not in ("tempo", "articulation", "rubato"))
    (tmp_path / "b.mpm").write_text("no document")
    assert performances.read(spark, f"file://{tmp_path}").table("tempo").count() == 2


def test_empty_maps_and_parts(spark, tmp_path):
    """One tempo for all, three articulations and a looping rubato in the first part, an empty map in the second."""
    text = DOCUMENT.split("<performance name=\"7\"")[0] + "</mpm>"
    (tmp_path / "b.mpm").write_text(text)
    s = performances.read(spark, f"file://{tmp_path}")
    assert s.table("tempo").count() == 1 and s.table("rubato").where("scope = 0 AND loop").count() == 1 and s.table("rubato").where("scope = 1").count() == 0


def plain(state, kinds):
    """Rows of tables as what they say: numbers rounded, JSON parsed, nulls and absent fields alike."""

    def value(v):
        if isinstance(v, float):
            return round(v, 9)
        if isinstance(v, str) and v[:1] in "{[\"":
            return value(json.loads(v))
        if isinstance(v, dict):
            return sorted((k, value(x)) for k, x in v.items() if x is not None)
        return [value(x) for x in v] if isinstance(v, (list, tuple)) else v

    return {k: sorted(repr([value(r[c]) for c in sorted(state.table(k).columns)]) for r in state.table(k).collect()) for k in kinds}


def test_a_chains_tables_survive_a_round_trip(spark, tmp_path):
    out = pipeline.Pipeline(CHAIN).run(played(spark))
    xml = performances.to_xml(out)
    assert xml.count() == 2
    xml.select("xml").write.text(f"file://{tmp_path}/out")
    back = performances.read(spark, f"file://{tmp_path}/out", multi_line=False)
    kinds = [*INSTRUCTIONS, "styles", "definitions", "metadata"]
    want, got = plain(out, kinds), plain(back, kinds)
    for k in kinds:
        assert got[k] == want[k], k
    assert sum(map(len, want.values())) > 40
    said = lambda s: sorted((r["perf_id"], r["instruction_id"], *r["corresp"]) for r in s.table("provenance").collect())
    known = {(r["perf_id"], r["id"]) for k in INSTRUCTIONS for r in out.table(k).collect()}
    assert said(back) == [r for r in said(out) if r[:2] in known]
    again = performances.to_xml(back, xml.select("perf_id"))
    assert sorted(r["xml"] for r in again.collect()) == sorted(r["xml"] for r in xml.collect())


def test_marks_in_texts_and_nothing_at_all(spark, tmp_path):
    kind = "perf_id long, scope int, id string, date double, name_ref string, note_order string, frame_start double"
    from tests.test_all_stages import nothing

    s = nothing(spark).inserted("ornament", spark.createDataFrame([(3, None, 'a"<b', 0.5, "x & y", "#1 #2", -1e-7), (3, 1, None, None, None, None, None)], kind))
    xml = performances.to_xml(s, spark.createDataFrame([(3,), (4,)], "perf_id long"))
    rows = {r["perf_id"]: r["xml"] for r in xml.collect()}
    assert rows[4].endswith('<performance name="4" pulsesPerQuarter="720"></performance></mpm>')
    xml.select("xml").write.text(f"file://{tmp_path}/out")
    back = performances.read(spark, f"file://{tmp_path}/out", multi_line=False)
    assert plain(back, ["ornament"]) == plain(s, ["ornament"])
    assert performances.to_xml(nothing(spark)).collect() == []


@pytest.mark.parametrize("n", [0, 1])
def test_part_numbers(spark, n):
    from tests.test_all_stages import nothing

    s = nothing(spark).inserted("tempo", spark.createDataFrame([(1, n, "t", 0.0, 60.0)], "perf_id long, scope int, id string, date double, bpm double"))
    x = performances.to_xml(s, s.table("tempo")).select(F.col("xml")).collect()[0]["xml"]
    assert f'number="{n + 1}"' in x and f'midi.channel="{n}"' in x
