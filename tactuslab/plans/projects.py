"""Project files: a reconstruction as JSON-LD, its argumentations, and the stages that each calls.

Options have other names and forms in files than in stages; both directions go by one table. What a file
holds beyond a stage's options is kept with the stage and written again.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.plans.registry import Registry
from tactuslab.plans.stages import Stage, registry

log = logging.getLogger(__name__)

# Names that project files use.
STAGE_NAMES = {"TranslatePhysicalTimeToTicks": "TranslatePhyiscalTimeToTicks"}
ASPECT_NAMES = {"rel_dur": "relativeDuration", "rel_vel": "relativeVelocity", "abs_dur": "absoluteDuration", "abs_dur_change": "absoluteDurationChange"}
RANGE = {"start": "from", "end": "to"}
OPTION_NAMES: dict[str, dict[str, str]] = {
    "MakeChoice": RANGE | {"note_ids": "noteIDs"},
    "Modify": RANGE | {"note_ids": "noteIDs"},
    "InsertTemporalSpread": {"threshold_ms": "durationThreshold"},
    "InsertDynamicsGradient": {"sort_velocities": "sortVelocities"},
    "ApproximateLogarithmicTempo": RANGE | {"beat_length": "beatLength", "silent_onsets": "silentOnsets", "go_on": "continue"},
    "TranslatePhysicalTimeToTicks": {"translate_modifiers": "translatePhysicalModifiers"},
    "StylizeOrnamentation": {"tick_tolerance": "tickTolerance", "intensity_tolerance": "intensityTolerance", "gradient_tolerance": "gradientTolerance"},
    "InsertRubato": {"start": "date"},
    "CombineAdjacentRubatos": {"intensity_tolerance": "intensityTolerance", "compression_tolerance": "compressionTolerance"},
    "InsertDynamicsInstructions": RANGE | {"phantom_velocities": "phantomVelocities"},
    "InsertMetricalAccentuation": RANGE | {"pattern": "name", "beat_length": "beatLength", "neutral_end": "neutralEnd", "scale_tolerance": "scaleTolerance"},
    "InsertArticulation": {"note_ids": "noteIDs", "articulation": "name"},
    "StylizeArticulation": {"volume_tolerance": "volumeTolerance", "duration_tolerance": "relativeDurationTolerance"},
    "InsertMetadata": {"related_resources": "relatedResources", "app_info": "appInfo"},
    "InsertAsynchrony": RANGE,
    "CompressOrnamentation": {"precision": "tickPrecision"},
    "InterpolateTimingImprecision": {"predefined": "predefinedImprecision"},
}
CONTEXT = {
    "crm": "http://www.cidoc-crm.org/cidoc-crm/",
    "crminf": "http://www.cidoc-crm.org/extensions/crminf/",
    "lrm": "http://iflastandards.info/ns/lrm/lrmoo/",
    "id": "@id",
    "ids": "@id",
    "type": "@type",
    "name": "crm:P2_has_type",
    "expression": "lrm:R3_is_realised_in",
    "creation": "lrm:R16i_was_created_by",
    "argumentations": {"@id": "crm:P9_consists_of", "@type": "crminf:I1_Argumentation"},
    "calls": {"@id": "crm:P9_consists_of", "@type": "crmdig:D10_Software_Execution"},
    "author": "crm:P14_carried_out_by",
    "encoder": "crm:P14_carried_out_by",
    "note": "crm:P3_has_note",
    "incorporates": "crm:P15_was_influenced_by",
    "conclusion": {"@id": "crminf:J2_concluded_that", "@type": "crminf:I2_Belief"},
    "that": "crminf:J27_that_the_formal_meaning_of",
    "certainty": "crminf:J5_holds_to_be",
}

#: Forms of single options: from a file's value, and back.
Form = tuple[Callable[[Any], Any], Callable[[Any], Any]]
_AS_IT_IS: Form = (lambda v: tuple(v) if isinstance(v, list) else v, lambda v: v)
_PAIR: Form = (lambda v: (v["from"], v["to"]) if isinstance(v, dict) else v, lambda v: {"from": v[0], "to": v[1]})
_FORMS: dict[str, Form] = {
    "scope": (lambda v: None if v == "global" else v, lambda v: "global" if v is None else v),
    "gradient": _PAIR,
    "crescendo": _PAIR,
    "decrescendo": _PAIR,
    "silent_onsets": (lambda v: tuple((x["date"], x["onset"]) if isinstance(x, dict) else tuple(x) for x in v), lambda v: [{"date": d, "onset": s} for d, s in v]),
    "phantom_velocities": (lambda v: tuple((d, x) for d, x in (v.items() if isinstance(v, dict) else v)), lambda v: dict(v)),
    "aspects": (lambda v: tuple(a for a, b in ASPECT_NAMES.items() if b in v or a in v), lambda v: {ASPECT_NAMES.get(a, a) for a in v}),
    "app_info": (lambda v: (v,) if isinstance(v, dict) else tuple(v), lambda v: v[0] if len(v) == 1 else list(v)),
}


def _tagged(key: str, value: Any) -> Any:
    if key == "phantom_velocities":
        return {"dataType": "Map", "value": [[d, v] for d, v in value.items()]}
    if isinstance(value, (set, frozenset)):
        return {"dataType": "Set", "value": sorted(value)}
    return value


def _revived(value: Any) -> Any:
    if isinstance(value, dict):
        if value.get("dataType") == "Set":
            return set(map(_revived, value["value"]))
        if value.get("dataType") == "Map":
            return {k: _revived(v) for k, v in value["value"]}
        return {k: _revived(v) for k, v in value.items()}
    return [_revived(v) for v in value] if isinstance(value, list) else value


def call_options(stage: Stage) -> dict:
    """The options of a stage as a file has them; those that aren't set are left out."""
    names, out = OPTION_NAMES.get(stage.name, {}), {}
    for key, value in stage.options.items():
        if (value is None and key != "scope") or (key == "app_info" and not value):
            continue
        if stage.name == "MakeChoice" and key == "prefer" and not value and stage.options["timing"]:
            continue
        out[names.get(key, key)] = _tagged(key, _FORMS.get(key, _AS_IT_IS)[1](value))
    if "scope" not in stage.defaults:
        out.pop("scope", None)
    if "noteIDs" in out and stage.name == "Modify":
        out = {k: v for k, v in out.items() if k not in ("from", "to")}
    return {**out, **stage.beside}


def stage_options(name: str, options: dict, known: Iterable[str]) -> tuple[dict, dict]:
    """A stage's options from those of a call, and what the stage has no use for."""
    names = {there: here for here, there in OPTION_NAMES.get(name, {}).items()}
    own, beside = {}, {}
    for there, value in options.items():
        key = names.get(there, there)
        if key in known:
            own[key] = _FORMS.get(key, _AS_IT_IS)[0](value)
        else:
            beside[there] = value
    return own, beside


def argumentations(stages: Iterable[Stage]) -> list[tuple[dict, list[Stage]]]:
    """Stages by the id of their argumentation, in the order they are first seen."""
    found: dict[str, tuple[dict, list[Stage]]] = {}
    for s in stages:
        if s.argumentation:
            found.setdefault(s.argumentation["id"], (s.argumentation, []))[1].append(s)
    return list(found.values())


def _groups(stages: Iterable[Stage]) -> list[tuple[dict, list[Stage]]]:
    """Stages by their argumentation itself, however its id reads; those without one together."""
    found: dict[int, tuple[dict, list[Stage]]] = {}
    for s in stages:
        found.setdefault(id(s.argumentation), (s.argumentation or {}, []))[1].append(s)
    return list(found.values())


def export_work(work: dict, stages: Iterable[Stage], secondary: dict | None = None) -> str:
    """A project as JSON-LD: its description, and the argumentations with the stages they call.

    The sources that choices prefer, for all or for velocity and timing, are what the project incorporates.
    """
    stages = list(stages)
    sources: list[str] = []
    for s in stages:
        if s.name == "MakeChoice":
            o = call_options(s)
            sources += [o["prefer"]] if "prefer" in o else [x for x in (o.get("velocity"), o.get("timing")) if x is not None]
    call = lambda s: {"id": s.id, "name": STAGE_NAMES.get(s.name, s.name), "options": call_options(s), "created": s.created}
    groups = [{**a, "calls": [call(s) for s in own]} for a, own in _groups(stages)]
    body = {"@context": CONTEXT, "@type": "Reconstruction", **work, "creation": {"incorporates": list(dict.fromkeys(sources)), "argumentations": groups}}
    return json.dumps({**body, **({"secondary": secondary} if secondary is not None else {})})


def import_work(text: str, stage_registry: Registry = registry) -> tuple[dict, list[Stage]]:
    """The description and the stages of a project, in the registry's order; unknown names are left out with a warning."""
    data = _revived(json.loads(text))
    creation = data.pop("creation", {})
    here = {there: name for name, there in STAGE_NAMES.items()}
    stages = []
    for a in creation.get("argumentations", []):
        argument = {k: v for k, v in a.items() if k != "calls"} or None
        for call in a.get("calls", []):
            name = here.get(call["name"], call["name"])
            if name not in stage_registry:
                log.warning("no stage named %s", call["name"])
                continue
            own, beside = stage_options(name, call.get("options") or {}, stage_registry.options(name))
            stage = stage_registry.create(name, id=call.get("id"), argumentation=argument, **own)
            stage.beside, stage.created = beside, list(call.get("created") or [])
            stages.append(stage)
    return {k: v for k, v in data.items() if k not in ("@context", "@type")}, stage_registry.sorted(stages)


def work_calls(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The calls of many project files at once: work, pos (in the file), argumentation, id, name, options as JSON, and what they created.

    A file is one project, or with multi_line off, one in each line.
    """
    call = "struct<id:string,name:string,options:string,created:array<string>>"
    kind = f"name string, creation struct<argumentations:array<struct<id:string,calls:array<{call}>>>>"
    rows = spark.read.schema(kind).option("multiLine", multi_line).json(path)
    rows = rows.select(F.col("name").alias("work"), F.posexplode("creation.argumentations").alias("i", "a"))
    rows = rows.select("work", "i", F.col("a.id").alias("argumentation"), F.posexplode("a.calls").alias("j", "c"))
    pos = F.col("i").cast("long") * (1 << 32) + F.col("j")
    return rows.select("work", pos.alias("pos"), "argumentation", "c.id", "c.name", "c.options", "c.created")


def missing_requirements(calls: DataFrame, stage_registry: Registry = registry) -> DataFrame:
    """Of the chains of many projects (work, pos, name): each call and stage that it requires and that doesn't stand before it."""
    rows = [(name, r) for name in stage_registry.order() for r in stage_registry.requirements(name)]
    required = F.broadcast(calls.sparkSession.createDataFrame(rows, "name string, requires string"))  # as many as the registry has
    first = calls.groupBy("work", F.col("name").alias("requires")).agg(F.min("pos").alias("_at"))
    out = calls.join(required, "name").join(first, ["work", "requires"], "left").where(F.col("_at").isNull() | (F.col("_at") >= F.col("pos")))
    return out.select("work", "pos", "name", "requires")
