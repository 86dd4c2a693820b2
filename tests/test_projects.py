"""Project files with the option names they have in the wild."""

import json

from tactuslab.plans import pipeline, stages

CALLS = [
    ("MakeChoice", {"prefer": "roll", "scope": "global"}),
    ("MakeChoice", {"velocity": "a", "timing": "b", "pedalling": "c", "from": 0, "to": 720, "scope": 1}),
    ("Modify", {"noteIDs": ["n1"], "aspect": "onset", "change": 0.5, "scope": "global"}),
    ("InsertTemporalSpread", {"placement": "estimate", "noteOffShiftTolerance": 500, "durationThreshold": 30, "scope": "global"}),
    ("InsertDynamicsGradient", {"crescendo": {"from": -1, "to": 0}, "decrescendo": {"from": 0, "to": -1}, "sortVelocities": True, "scope": 0}),
    ("ApproximateLogarithmicTempo", {"from": 2880, "to": 5760, "beatLength": 0.25, "silentOnsets": [{"date": 3600, "onset": 2.5}], "continue": True, "scope": "global"}),
    ("ApproximateLogarithmicTempo", {"from": 0, "to": 2880, "beatLength": 0.25, "silentOnsets": [], "scope": "global"}),
    ("TranslatePhyiscalTimeToTicks", {"translatePhysicalModifiers": False, "translatePedalling": True}),
    ("InsertRubato", {"date": 720, "length": 1440, "scope": "global"}),
    ("CombineAdjacentRubatos", {"intensityTolerance": 0.3, "compressionTolerance": 0.2, "scope": "global"}),
    ("InsertDynamicsInstructions", {"from": 0, "to": 720, "phantomVelocities": {"dataType": "Map", "value": [[360, 50]]}, "scope": "global"}),
    ("InsertMetricalAccentuation", {"name": "p", "from": 0, "to": 2880, "beatLength": 0.25, "neutralEnd": False, "scaleTolerance": 2, "scope": "global"}),
    ("InsertArticulation", {"noteIDs": ["n1", "n2"], "name": "short", "aspects": {"dataType": "Set", "value": ["absoluteDuration", "relativeDuration"]}, "scope": "global"}),
    ("StylizeArticulation", {"volumeTolerance": 0.02, "relativeDurationTolerance": 0.3}),
    ("InsertPedal", {"start": -60, "duration": 120, "direction": "up", "depth": 1}),
    ("InsertMetadata", {"authors": [{"number": 1, "text": "A"}], "appInfo": {"name": "x", "version": "1", "url": "u"}}),
]


def project():
    calls = [{"id": f"c{k}", "name": name, "options": options, "created": [f"i{k}"]} for k, (name, options) in enumerate(CALLS)]
    groups = [{"id": "a", "type": "simpleArgumentation", "calls": calls[:8]}, {"id": "a", "note": "the same id", "calls": calls[8:]}]
    return {"@context": {}, "@type": "Reconstruction", "name": "n", "mpm": "m", "mei": "e", "creation": {"incorporates": [], "argumentations": groups}}


def test_options_are_mapped_and_sorted():
    work, chain = pipeline.import_work(json.dumps(project()))
    assert work == {"name": "n", "mpm": "m", "mei": "e"} and len(chain) == len(CALLS)
    by_id = {s.id: s.options for s in chain}
    assert (by_id["c1"]["start"], by_id["c1"]["end"], by_id["c1"]["scope"]) == (0, 720, 1) and by_id["c0"]["scope"] is None
    assert by_id["c5"]["silent_onsets"] == ((3600, 2.5),) and by_id["c5"]["go_on"]
    assert by_id["c8"]["start"] == 720 and by_id["c10"]["phantom_velocities"] == ((360, 50),)
    assert by_id["c12"]["aspects"] == ("rel_dur", "abs_dur") and by_id["c13"]["duration_tolerance"] == 0.3
    names = [s.name for s in chain]
    assert names == sorted(names, key=stages.registry.order().index)
    assert [s.id for s in chain if s.name == "ApproximateLogarithmicTempo"] == ["c6", "c5"]
    assert not pipeline.Pipeline(chain).validate()


def test_a_project_is_written_as_it_was_read():
    text = pipeline.export_work({"name": "n", "mpm": "m", "mei": "e"}, pipeline.import_work(json.dumps(project()))[1], {"x": 1})
    back = json.loads(text)
    assert back["@type"] == "Reconstruction" and "crm" in back["@context"] and back["secondary"] == {"x": 1}
    assert back["creation"]["incorporates"] == ["roll", "a", "b"]
    groups = back["creation"]["argumentations"]
    assert [len(g["calls"]) for g in groups] == [8, 8] and groups[1]["note"] == "the same id"
    calls = {c["id"]: c for g in groups for c in g["calls"]}
    for k, (name, options) in enumerate(CALLS):
        got = calls[f"c{k}"]
        assert got["name"] == name and got["created"] == [f"i{k}"]
        assert {o: got["options"].get(o) for o in options} == options
    again = pipeline.import_work(text)[1]
    assert [(s.id, s.options) for s in again] == [(s.id, s.options) for s in pipeline.import_work(json.dumps(project()))[1]]
