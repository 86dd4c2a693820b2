"""Calls as data: the chains of many works at once, each work with calls and options of its own.

A table of calls has one row for each: perf_id, pos (its place in the file), id, name, argumentation (an
id or null) and options as JSON, as projects.work_calls gives them. Options become typed columns, and calls
are grouped by steps: the first call of a stage in every work, the second of those that have two, and so
on. A step is one stage over all works that take part in it, with options joined by perf_id. There are
as many steps as the longest chain of any work has, however many works there are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.model import Keyed, State
from tactuslab.operators.relops import saved
from tactuslab.plans.projects import ASPECT_NAMES, CONTEXT, OPTION_NAMES, STAGE_NAMES, missing_requirements
from tactuslab.plans.registry import Registry
from tactuslab.plans.stages import Stage, registry

_PAIR = "struct<`from`:double,`to`:double>"
_LONG, _DOUBLE, _TEXT, _FLAG, _TEXTS = "long", "double", "string", "boolean", "array<string>"

#: What options are in stages.
TYPES: dict[str, str] = {
    **dict.fromkeys(("start", "end", "date", "length", "part", "precision"), _LONG),
    **dict.fromkeys(("change", "threshold_ms", "beat_length", "tick_tolerance", "intensity_tolerance", "gradient_tolerance", "compression_tolerance", "scale_tolerance", "volume_tolerance"), _DOUBLE),
    **dict.fromkeys(("duration_tolerance", "duration", "depth", "predefined"), _DOUBLE),
    **dict.fromkeys(("prefer", "timing", "velocity", "pedalling", "aspect", "placement", "pattern", "into", "articulation", "pedal", "direction"), _TEXT),
    **dict.fromkeys(("sort_velocities", "go_on", "translate_modifiers", "neutral_end"), _FLAG),
    **dict.fromkeys(("note_ids", "names", "aspects", "authors", "comments", "related_resources", "app_info"), _TEXTS),
    **dict.fromkeys(("gradient", "crescendo", "decrescendo"), _PAIR),
    "scope": "int", "silent_onsets": "array<struct<date:long,onset:double>>", "phantom_velocities": "map<int,double>",
}

#: How some of them are written in files, and what makes the one of the other.
_AS_JSON = ("authors", "comments", "related_resources")
_WRITTEN: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "scope": (_TEXT, lambda c: F.nullif(c, F.lit("global")).try_cast("int")),
    "silent_onsets": ("array<struct<date:double,onset:double>>", lambda c: c),
    "phantom_velocities": ("struct<dataType:string,value:array<array<double>>>", lambda c: F.map_from_entries(F.transform(c.value, lambda x: F.struct(x[0].cast("int"), x[1])))),
    "aspects": ("struct<dataType:string,value:array<string>>", lambda c: F.filter(F.array(*map(F.lit, ASPECT_NAMES)), lambda a: F.array_contains(c.value, F.element_at(F.create_map(*[F.lit(x) for p in ASPECT_NAMES.items() for x in p]), a)))),
    "app_info": ("variant", lambda c: F.when(c.isNull(), F.lit(None)).when(F.schema_of_variant(c).startswith("ARRAY"), F.transform(c.cast("array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(F.to_json(c)))),
    **dict.fromkeys(_AS_JSON, ("array<variant>", lambda c: F.transform(c, lambda x: F.to_json(x)))),
}


def _type(stage: type[Stage], option: str) -> str:
    return _DOUBLE if stage.name == "InsertPedal" and option == "start" else TYPES[option]


def _default(stage: type[Stage], option: str) -> Column:
    value, kind = stage.defaults[option], _type(stage, option)
    if kind == _PAIR and value is not None:
        return F.struct(F.lit(float(value[0])).alias("from"), F.lit(float(value[1])).alias("to"))
    if isinstance(value, tuple):
        return F.lit(None).cast(kind) if kind.startswith("map") else F.array(*map(F.lit, value)).cast(kind)
    return F.lit(value).cast(kind)


def typed_options(calls: DataFrame, stage: type[Stage]) -> DataFrame:
    """calls of one stage with a column for each of its options in place of their JSON; what isn't given, or can't be read, has its default."""
    names = OPTION_NAMES.get(stage.name, {})
    fields, values = [], []
    for option in stage.defaults:
        kind = _type(stage, option)
        written, form = _WRITTEN.get(option, (_DOUBLE if kind == _LONG else kind, lambda c: c))
        there = names.get(option, option)
        fields.append(f"`{there}` {written}")
        values.append(F.coalesce(form(F.col("_j").getField(there)).cast(kind), _default(stage, option)).alias(option))
    if not fields:
        return calls.drop("options")
    return calls.withColumn("_j", F.from_json("options", ", ".join(fields))).select(*[c for c in calls.columns if c != "options"], *values)


def steps(calls: DataFrame, stage_registry: Registry = registry) -> DataFrame:
    """calls with name as in the registry, place (the stage's in the order) and k, which of the work's calls of that stage it is, from 1.

    Names that the registry doesn't have are left out. Calls of one stage keep their order, but of neighbours
    that both cover a range the earlier one comes first. Rows equal in perf_id and pos are ordered by id.
    """
    here = F.create_map(*[F.lit(x) for name, there in STAGE_NAMES.items() for x in (there, name)])
    places = F.create_map(*[F.lit(x) for name in stage_registry.order() for x in (name, stage_registry.place(name))])
    begins = F.create_map(*[F.lit(x) for name in stage_registry.order() for x in (name, stage_registry.ranged(name))])
    rows = calls.withColumn("name", F.coalesce(F.try_element_at(here, F.col("name")), "name")).withColumn("place", F.try_element_at(places, F.col("name"))).where("place IS NOT NULL")
    start = F.when(F.try_element_at(begins, F.col("name")), F.get_json_object("options", "$.from").try_cast("double"))
    own = Window.partitionBy("perf_id", "name")
    rows = rows.withColumn("_start", start).withColumn("_run", F.sum(F.col("_start").isNull().cast("int")).over(own.orderBy("pos", "id")))
    return rows.withColumn("k", F.row_number().over(own.orderBy("_run", F.col("_start").asc_nulls_first(), "pos", "id"))).drop("_start", "_run")


def keyed(stage: type[Stage], options: DataFrame) -> Stage:
    """A stage whose id, argumentation and options are columns of a table with one row a performance."""
    own = {name: Keyed(options, name, F.col(name)) for name in stage.defaults}
    return stage(id=Keyed(options, "_call", F.col("id")), argumentation=Keyed(options, "_argument", F.col("argumentation")), **own)


def _joined(before: State, inside: State, out: State, works: DataFrame) -> State:
    """out for the works of a step beside what the others have; what the step has left alone isn't written again."""

    def rest(df: DataFrame) -> DataFrame:
        return df.join(works, "perf_id", "left_anti")

    tables = dict(before.tables)
    for name, t in out.tables.items():
        if t is inside.tables.get(name):
            continue
        tables[name] = saved(rest(before.tables[name]).unionByName(t.select(*before.tables[name].columns)) if name in before.tables else t, name)
    notes = before.notes if out.notes is inside.notes else saved(rest(before.notes).unionByName(out.notes, allowMissingColumns=True), "notes")
    pedals = before.pedals if out.pedals is inside.pedals else saved(rest(before.pedals).unionByName(out.pedals, allowMissingColumns=True), "pedals")
    return State(notes, pedals, before.meta, tables)


def created(state: State) -> DataFrame:
    """What each call has inserted: perf_id, id (the call's) and created, the ids of its instructions by name."""
    rows = state.table("provenance").groupBy("perf_id", F.col("transformer_id").alias("id"))
    return rows.agg(F.array_sort(F.collect_set("instruction_id")).alias("created"))


def export_works(calls: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """perf_id and json: the project file of each work, one line, with what made (of created) says that its calls have created.

    A file has the work's name, its argumentations in the order of their first call, those of no argumentation
    together, and the calls as they were read. It is what projects.import_work and work_calls read.
    """
    rows = calls if made is None else calls.drop("created").join(made, ["perf_id", "id"], "left")
    none = F.array().cast("array<string>")
    have = F.coalesce("created", none) if "created" in rows.columns else none
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    call = F.concat(
        F.lit('{"id":'), F.coalesce(quoted(F.col("id")), F.lit("null")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"options":'), F.coalesce("options", F.lit("{}")), F.lit(',"created":'), F.to_json(have), F.lit("}"),
    )
    groups = rows.groupBy("perf_id", "argumentation").agg(F.min("pos").alias("_at"), F.array_sort(F.collect_list(F.struct("pos", "id", call.alias("c")))).alias("_calls"))
    own = F.array_join(F.transform("_calls", lambda x: x.c), ",")
    argument = F.coalesce(F.concat(F.lit('"id":'), quoted(F.col("argumentation")), F.lit(",")), F.lit(""))
    group = F.concat(F.lit("{"), argument, F.lit('"calls":['), own, F.lit("]}"))
    works = groups.groupBy("perf_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", group.alias("g")))), lambda x: x.g), ",").alias("a"))
    head = json.dumps({"@context": CONTEXT, "@type": "Reconstruction"})[:-1]
    name = F.concat(F.lit(', "name":"'), F.col("perf_id").cast("string"), F.lit('", "creation":{"incorporates":[],"argumentations":['))
    return works.select("perf_id", F.concat(F.lit(head), name, F.col("a"), F.lit("]}}")).alias("json"))


def run_calls(state: State, calls: DataFrame, check: bool = True, stage_registry: Registry = registry) -> State:
    """The chains of all works over their performances, step by step. Works without calls stay as they are.

    With check, calls whose requirements don't stand before them are refused.
    """
    rows = saved(steps(calls.select("perf_id", "pos", "id", "name", "argumentation", "options"), stage_registry), "calls")
    if check:
        order = F.row_number().over(Window.partitionBy("perf_id").orderBy("place", "k"))
        lacking = missing_requirements(rows.select(F.col("perf_id").alias("work"), order.alias("pos"), "name"), stage_registry).limit(5).collect()
        if lacking:
            raise ValueError("; ".join(f"{r['name']} of work {r['work']} requires {r['requires']} before it in the chain" for r in lacking))
    for name, _, k in rows.select("name", "place", "k").distinct().orderBy("place", "k").collect():
        stage = stage_registry.stage(name)
        options = saved(typed_options(rows.where((F.col("name") == name) & (F.col("k") == k)).drop("name", "place", "k", "pos"), stage), "options")
        works = options.select("perf_id")
        own = lambda df, works=works: df.join(works, "perf_id", "left_semi")
        inside = State(own(state.notes), own(state.pedals), own(state.meta), {n: own(t) for n, t in state.tables.items()})
        state = _joined(state, inside, keyed(stage, options).run(inside), works)
    return state
