"""The stages of the chain: each explains a part of the notes by instructions and passes on the rest.

A stage gets a State and gives a new one. Instructions get ids of their type and date, numbered where
several share both, and provenance rows that tell which stage and which argument they come from.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.model import Keyed, State, by_performance, defined, listed, scoped
from tactuslab.operators import accentuation, articulation, dynamics, ornaments, relops, rubato, tempo, ticks
from tactuslab.operators import notes as ops
from tactuslab.plans.registry import Registry

registry = Registry()


def with_ids(rows: DataFrame, kind: str, existing: DataFrame | None = None) -> DataFrame:
    """rows with id: kind_date, from the second of a date on with a number; those of existing are counted first.

    Rows of one date are numbered by seq, if they have it, and then by what they hold, so that a task that is
    run again gives the same ids.
    """
    date = F.when(F.col("date") == F.floor("date"), F.floor("date").cast("string")).otherwise(F.col("date").cast("string"))
    rows = rows.drop("id")
    order = ["seq"] * ("seq" in rows.columns) + [c for c, t in rows.dtypes if c not in ("perf_id", "date", "seq") and not t.startswith("map")]
    k = F.row_number().over(Window.partitionBy("perf_id", "date").orderBy(*order or ["date"])) - 1
    rows = rows.withColumn("_k", k)
    if existing is not None:
        rows = rows.join(existing.groupBy("perf_id", "date").agg(F.count(F.lit(1)).alias("_n")), ["perf_id", "date"], "left").withColumn("_k", F.col("_k") + F.coalesce("_n", F.lit(0))).drop("_n")
    return rows.withColumn("id", F.concat(F.lit(f"{kind}_"), date, F.when(F.col("_k") > 0, F.concat(F.lit("_"), F.col("_k"))).otherwise(""))).drop("_k")


class Stage:
    """Base of all stages. options are plain values, so that a chain can be written as JSON.

    Where each performance has options of its own they are Keyed, as are id and argumentation then
    (plans.calls makes such stages of a table of calls).
    """

    name: ClassVar[str] = ""
    requires: ClassVar[tuple[str, ...]] = ()
    defaults: ClassVar[dict[str, Any]] = {}
    #: Whether start and end are a range of score dates that the stage covers, by which equal stages are ordered.
    ranged: ClassVar[bool] = False

    def __init__(self, id: str | Keyed | None = None, argumentation: dict | Keyed | None = None, **options: Any) -> None:
        unknown = set(options) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.name} has no options {sorted(unknown)}")
        self.id = id or uuid.uuid4().hex
        self.argumentation = argumentation
        self.options = {**self.defaults, **options}
        #: What a project file says of this call beside its options, and the ids of what it is known to have created.
        self.beside: dict[str, Any] = {}
        self.created: list[str] = []

    def transform(self, state: State) -> State:
        raise NotImplementedError

    def run(self, state: State, kept: Callable[[Stage, State, State], State] | None = None) -> State:
        """transform, then a provenance row for each new instruction. kept writes what the stage has made, so that the rows are read from there."""
        out = self.transform(state)
        if kept is not None:
            out = kept(self, state, out)
        for kind, rows in out.tables.items():
            if kind in ("definitions", "styles", "metadata", "provenance") or rows is state.tables.get(kind):
                continue
            new = rows.select("perf_id", "id")
            if kind in state.tables:
                new = new.join(state.tables[kind].select("perf_id", "id"), ["perf_id", "id"], "left_anti")
            argument = self.argumentation if isinstance(self.argumentation, Keyed) else (self.argumentation or {}).get("id")
            new, own, argument = by_performance(new, self.id, argument)
            corresp = F.array(F.coalesce(F.lit(argument), F.lit(own)))
            out = out.inserted("provenance", new.select("perf_id", F.lit(own).alias("transformer_id"), F.col("id").alias("instruction_id"), corresp.alias("corresp")))
        return out if kept is None else kept(self, state, out)

    def _scope(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        """rows, and the stage's scope over them."""
        rows, scope = by_performance(rows, self.options.get("scope"))
        return rows, F.lit(scope).cast("int")

    def _insert(self, state: State, kind: str, rows: DataFrame) -> State:
        rows, scope = self._scope(with_ids(rows.withColumn("date", F.col("date").cast("double")), kind, state.table(kind)))
        return state.inserted(kind, rows.withColumn("scope", scope))

    def _define(self, state: State, kind: str, rows: DataFrame, *body: str) -> State:
        """Definitions (perf_id, name, and the columns of body as JSON) and a style switch at 0 where there is none."""
        rows, scope = self._scope(rows)
        return state.inserted("definitions", rows.select("perf_id", scope.alias("scope"), F.lit(kind).alias("def_type"), "name", F.to_json(F.struct(*body)).alias("body")))

    def _style(self, state: State, map_type: str, rows: DataFrame) -> State:
        have = scoped(state.table("styles"), self.options.get("scope")).where(F.col("map_type") == map_type).select("perf_id")
        rows, scope = self._scope(rows.join(have, "perf_id", "left_anti"))
        default = F.col("default_articulation") if "default_articulation" in rows.columns else F.lit(None).cast("string")
        return state.inserted("styles", rows.select("perf_id", scope.alias("scope"), F.lit(map_type).alias("map_type"), F.lit(f"style_{map_type}").alias("id"), F.lit(0.0).alias("date"), F.lit("performance_style").alias("name_ref"), default.alias("default_articulation")))


class MakeChoice(Stage):
    """Choose among takes of a note, by source; velocity and pedalling may be another source's."""

    name = "MakeChoice"
    ranged = True
    defaults = {"prefer": "", "timing": None, "velocity": None, "pedalling": None, "start": None, "end": None, "note_ids": None, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        timing, velocity, pedalling = (o[k].either(o["prefer"]) if isinstance(o[k], Keyed) else o[k] if o[k] is not None else o["prefer"] for k in ("timing", "velocity", "pedalling"))
        notes = ops.make_choice(state.notes, timing, velocity, o["start"], o["end"], o["note_ids"])
        pedals = ops.choose_pedals(state.pedals, pedalling, o["start"], o["end"]) if pedalling else state.pedals
        return replace(state, notes=notes, pedals=pedals)


class Modify(Stage):
    """Add to velocity, onset or duration of some notes."""

    name = "Modify"
    ranged = True
    defaults = {"aspect": "velocity", "change": 0.0, "start": 0, "end": 0, "note_ids": None, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        return state.with_notes(ops.modify(state.notes, o["aspect"], o["change"], o["start"], o["end"], o["note_ids"], o["scope"]))


class InsertTemporalSpread(Stage):
    name = "InsertTemporalSpread"
    defaults = {"placement": "estimate", "threshold_ms": 35.0, "date": None, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        rows, notes = ornaments.temporal_spread(state.notes, o["placement"], o["threshold_ms"], o["date"], o["scope"])
        return self._insert(state, "ornament", rows).with_notes(notes)


class InsertDynamicsGradient(Stage):
    name = "InsertDynamicsGradient"
    defaults = {"date": None, "gradient": None, "crescendo": (-1.0, 0.0), "decrescendo": (0.0, -1.0), "sort_velocities": False, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        rows, notes = ornaments.dynamics_gradient(state.notes, o["gradient"] or None, o["date"], o["crescendo"], o["decrescendo"], o["sort_velocities"], o["scope"])
        return self._insert(state, "ornament", rows.drop("standard")).with_notes(notes)


class ApproximateLogarithmicTempo(Stage):
    """Fit power-curve tempos between start and end; with go_on together with the chain of tempos that leads there."""

    name = "ApproximateLogarithmicTempo"
    ranged = True
    defaults = {"start": 0, "end": 0, "beat_length": 0.25, "silent_onsets": (), "go_on": False, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        notes, pedals = ops.shift_to_first_onset(state.notes, state.pedals)
        state = replace(state, notes=notes, pedals=pedals)
        played = notes.join(state.meta.where("ts_numerator IS NOT NULL").select("perf_id"), "perf_id", "left_semi")
        rows, part = by_performance(played, o["scope"])
        played = ops.in_part(rows, part).select(*played.columns)
        fitted = relops.saved(self.preview(state, played), "fitted")
        have = scoped(state.table("tempo"), o["scope"])
        start = fitted.groupBy("perf_id").agg(F.min("date").alias("start"))
        kept = tempo.replaced_from(have, start, o["end"])
        # A chain that is fitted anew has no use for what its former last tempo would go on with.
        kept, end, begin = by_performance(kept.join(start.withColumnRenamed("start", "_first"), "perf_id", "left"), o["end"], o["start"])
        kept = kept.where(~(F.col("restored") & F.coalesce(F.col("_first") < F.lit(begin), F.lit(False))))
        kept = kept.withColumn("id", F.when(F.col("restored"), F.concat(F.lit("tempo_"), F.lit(end).cast("string"))).otherwise(F.col("id")))
        others = scoped(state.table("tempo"), o["scope"], others=True)
        rest = others.unionByName(kept.select(*have.columns))
        new, scope = self._scope(with_ids(fitted, "tempo", rest))
        new = new.withColumn("scope", scope)
        rest = rest.unionByName(new.select(*have.columns))
        return state.with_table("tempo", relops.saved(rest, "tempo"))

    def preview(self, state: State, played: DataFrame | None = None) -> DataFrame:
        """The tempos that would be inserted."""
        o = self.options
        played = state.notes if played is None else played
        have = relops.with_end(scoped(state.table("tempo"), o["scope"]), relops.ends(state.notes))
        given = o["silent_onsets"]
        if not isinstance(given, (Keyed, Column)):
            given = F.array(*[F.struct(F.lit(int(d)).cast("long").alias("date"), F.lit(float(s)).alias("onset")) for d, s in given]) if given else F.array().cast("array<struct<date:bigint,onset:double>>")
        silent, given = by_performance(played.select("perf_id").distinct(), given)
        silent = silent.select("perf_id", F.explode(given).alias("x")).select("perf_id", "x.date", "x.onset")
        chain = have.limit(0)
        if o["go_on"] is not False:
            # What leads up to the start ends there at the latest, however long it would go on.
            cut, at = by_performance(have, o["start"])
            cut = cut.withColumn("end_date", F.least("end_date", F.lit(at).cast("double")))
            chain, go_on = by_performance(tempo.chain_before(cut.select(*have.columns), o["start"], o["beat_length"]), o["go_on"])
            chain = chain.where(F.lit(go_on))
        marks = chain.groupBy("perf_id").agg(F.collect_set("date").alias("marks"))
        reach, start, end = by_performance(played.select("perf_id").distinct().join(marks, "perf_id", "left"), o["start"], o["end"])
        own = F.array(F.lit(start).cast("double"), F.lit(end).cast("double"))
        reach = reach.select("perf_id", F.array_sort(F.array_union(F.coalesce("marks", F.array().cast("array<double>")), own)).alias("marks"), F.lit(end).cast("double").alias("_end"))
        onsets = tempo.merged_onsets(played, silent, -(1 << 60), 1 << 60).join(reach, "perf_id")
        onsets = onsets.where((F.col("date") >= F.element_at("marks", 1)) & (F.col("date") <= F.col("_end")))
        return tempo.fit_chains(onsets, o["beat_length"])


class TranslatePhysicalTimeToTicks(Stage):
    name = "TranslatePhysicalTimeToTicks"
    defaults = {"translate_modifiers": True, "scope": None}

    def transform(self, state: State) -> State:
        tempos = scoped(state.table("tempo"), self.options["scope"])
        frames = relops.saved(ticks.frames(tempos, state.notes), "frames")
        notes = relops.saved(ticks.tick_onsets(state.notes, tempos, frames), "ticks")
        out = state
        if self.options["translate_modifiers"] is not False and "ornament" in state.tables:
            o = state.table("ornament")
            rows, wanted = by_performance(o, self.options["translate_modifiers"])
            framed = F.col("frame_start").isNotNull() & F.coalesce(F.lit(wanted), F.lit(True))
            moved = ticks.ornament_ticks(rows.where(framed).select(*o.columns), notes, tempos, frames)
            out = out.with_table("ornament", moved.unionByName(rows.where(~framed).select(*o.columns)))
        pedals = ticks.pedal_ticks(state.pedals, notes, tempos, frames)
        return replace(out, notes=ticks.tick_durations(notes, tempos, frames), pedals=pedals)


class StylizeOrnamentation(Stage):
    name = "StylizeOrnamentation"
    requires = ("InsertDynamicsGradient", "InsertTemporalSpread")
    defaults = {"tick_tolerance": 10.0, "intensity_tolerance": 0.3, "gradient_tolerance": 0.1, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        rows = scoped(state.table("ornament"), o["scope"])
        others = scoped(state.table("ornament"), o["scope"], others=True)
        out, defs = ornaments.stylized(rows, o["tick_tolerance"], o["intensity_tolerance"], o["gradient_tolerance"])
        defs = relops.saved(defs, "ornament-defs")
        state = state.with_table("ornament", relops.saved(others.unionByName(out), "ornament"))
        state = self._define(state, "ornamentDef", defs, "frame_start", "frame_length", "intensity", "noteoff_shift", "time_unit", "transition_from", "transition_to")
        return self._style(state, "ornament", defs.select("perf_id").distinct())


class InsertRubato(Stage):
    name = "InsertRubato"
    requires = ("TranslatePhysicalTimeToTicks",)
    defaults = {"start": 0, "length": 720, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        rows = relops.saved(rubato.insert_rubato(state.notes, o["start"], o["length"], o["scope"]), "rubato")
        return self._insert(state, "rubato", rows).with_notes(rubato.removed(state.notes, rows, o["scope"]))


class CombineAdjacentRubatos(Stage):
    name = "CombineAdjacentRubatos"
    requires = ("InsertRubato",)
    defaults = {"intensity_tolerance": 0.2, "compression_tolerance": 0.1, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        own = scoped(state.table("rubato"), o["scope"])
        others = scoped(state.table("rubato"), o["scope"], others=True)
        rows = rubato.combined(own.drop("id", "scope", "loop"), ops.extent(state.notes), o["intensity_tolerance"], o["compression_tolerance"])
        rows, scope = self._scope(with_ids(rows, "rubato"))
        return state.with_table("rubato", others.unionByName(rows.withColumn("scope", scope).select(*others.columns)))


class InsertDynamicsInstructions(Stage):
    name = "InsertDynamicsInstructions"
    ranged = True
    defaults = {"start": 0, "end": 0, "phantom_velocities": (), "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        phantoms = o["phantom_velocities"]
        phantoms = phantoms if isinstance(phantoms, Keyed) else {int(d): float(v) for d, v in phantoms}
        points = dynamics.points(state.notes, phantoms, o["start"], o["end"], o["scope"])
        state = self._insert(state, "dynamics", relops.saved(dynamics.fit_dynamics(points), "dynamics"))
        return state.with_notes(dynamics.residual(state.notes, scoped(state.table("dynamics"), o["scope"]), o["scope"]))


class InsertMetricalAccentuation(Stage):
    name = "InsertMetricalAccentuation"
    ranged = True
    requires = ("InsertDynamicsInstructions",)
    defaults = {"pattern": "my-accentuation", "start": 0, "end": 0, "beat_length": 0.25, "neutral_end": False, "scale_tolerance": 0.0, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        found = accentuation.looped(state.notes, state.meta, o["start"], o["end"], o["beat_length"], o["neutral_end"], o["scale_tolerance"], None, o["scope"])
        found = relops.saved(found, "accents")
        neutral = F.lit("neutral")
        notes = accentuation.accent_residual(state.notes, found, state.meta, o["start"], o["end"], None, o["scope"])
        found, pattern, start, end = by_performance(found, o["pattern"], o["start"], o["end"])
        name, begin = F.lit(pattern), F.lit(start).cast("double")
        defs = found.join(state.meta, "perf_id").select("perf_id", name.alias("name"), "children", ((F.lit(end) - begin) / 2880.0 * F.col("ts_denominator")).alias("length"))
        flat = F.array(F.struct(F.lit(1.0).alias("beat"), F.lit(0.0).alias("value"), F.lit(0.0).alias("transition_from"), F.lit(0.0).alias("transition_to")))
        have = state.table("definitions").where("name = 'neutral'").select("perf_id")
        calm = found.join(have, "perf_id", "left_anti").select("perf_id", neutral.alias("name"), flat.alias("children"), F.lit(0.25).alias("length"))
        state = self._define(state, "accentuationPatternDef", calm.unionByName(defs), "children", "length")
        rows = found.select("perf_id", begin.alias("date"), name.alias("name_ref"), "scale", F.when(F.col("loop"), True).alias("loop"))
        after = found.where("loop").select("perf_id", F.col("neutral_date").cast("double").alias("date"), neutral.alias("name_ref"), F.lit(0.0).alias("scale"), F.lit(None).cast("boolean").alias("loop"))
        state = self._insert(state, "accentuation_pattern", rows.unionByName(after)).with_notes(notes)
        return self._style(state, "accentuationPattern", found.select("perf_id"))


class MergeMetricalAccentuations(Stage):
    name = "MergeMetricalAccentuations"
    requires = ("InsertMetricalAccentuation",)
    defaults = {"names": (), "into": "", "scope": None}
    BODY = "children array<struct<beat:double,value:double,transition_from:double,transition_to:double>>, length double"

    def transform(self, state: State) -> State:
        o = self.options
        defs = state.table("definitions")
        own, names = by_performance(scoped(defs, o["scope"]).where("def_type = 'accentuationPatternDef'"), o["names"])
        names = names if isinstance(names, Column) else F.array(*map(F.lit, names)).cast("array<string>")
        own = own.where(listed(names, "name"))
        parsed = own.select("perf_id", "name", F.from_json("body", self.BODY).alias("b"), F.array_position(names, F.col("name")).alias("pos"))
        merged = accentuation.merged(parsed.select("perf_id", "pos", "name", F.explode("b.children").alias("c")).select("perf_id", "pos", "name", "c.*"), o["names"] if isinstance(o["names"], Keyed) else list(o["names"]), o["into"])
        length = parsed.groupBy("perf_id").agg(F.min_by("b.length", "pos").alias("length"))
        accent = F.struct("beat", "value", "transition_from", "transition_to")
        new = relops.saved(merged.groupBy("perf_id", "name").agg(F.array_sort(F.collect_list(accent)).alias("children")).join(length, "perf_id"), "merged-accents")
        hit = new.select("perf_id", F.lit(True).alias("_m"))
        named = lambda rows: by_performance(rows.join(hit, "perf_id", "left"), o["names"], o["scope"], o["into"])
        rows, names, scope, into = named(defs)
        names = names if isinstance(names, Column) else list(names)
        gone = F.coalesce(F.col("_m"), F.lit(False)) & (F.col("def_type") == "accentuationPatternDef") & listed(names, "name") & F.col("scope").eqNullSafe(F.lit(scope).cast("int"))
        state = state.with_table("definitions", rows.where(~gone).select(*defs.columns))
        state = self._define(state, "accentuationPatternDef", new, "children", "length")
        have = state.table("accentuation_pattern")
        rows, *_ = named(have)
        renamed = F.when(F.col("_m") & listed(names, "name_ref"), F.lit(into)).otherwise(F.col("name_ref"))
        return state.with_table("accentuation_pattern", rows.withColumn("name_ref", renamed).select(*have.columns))


class InsertArticulation(Stage):
    name = "InsertArticulation"
    requires = ("TranslatePhysicalTimeToTicks",)
    defaults = {"note_ids": (), "articulation": "articulation", "aspects": ("rel_dur",), "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        plain = lambda x: x if isinstance(x, Keyed) else list(x)
        chosen = articulation.values(ops.by_id(state.notes, plain(o["note_ids"])))
        defs, name = by_performance(articulation.definition(chosen, plain(o["aspects"])), o["articulation"])
        defs = defs.withColumn("name", F.lit(name))
        notes = articulation.undone(state.notes, chosen, defs)
        state = self._define(state, "articulationDef", defs, *articulation.ASPECTS)
        return self._insert(state, "articulation", articulation.instructions(chosen, o["articulation"])).with_notes(notes)


class StylizeArticulation(Stage):
    """Cluster articulations that carry their own values, point them to definitions, make the largest the default."""

    name = "StylizeArticulation"
    requires = ("InsertArticulation",)
    defaults = {"volume_tolerance": 0.01, "duration_tolerance": 0.2, "scope": None}

    def transform(self, state: State) -> State:
        o = self.options
        all_rows = state.table("articulation").withColumn("_row", F.monotonically_increasing_id())
        all_rows = relops.saved(all_rows, "articulations")  # which keeps the numbers
        own = scoped(all_rows, o["scope"]).where(defined("rel_dur") & defined("rel_vel"))
        own = own.select("perf_id", "_row", "date", F.substring(F.get("noteid", F.lit(0)), 2, 1 << 20).alias("_note"), "rel_dur", "rel_vel")
        found, defs = articulation.clustered(own.withColumn("seq", F.col("_row")), o["volume_tolerance"], o["duration_tolerance"])
        found, defs = relops.saved(found, "found"), relops.saved(defs, "articulation-defs")
        # An articulation is one of a note, or of all notes of its date.
        means = found.join(defs.select("perf_id", "label", F.col("rel_dur").alias("mean")), ["perf_id", "label"])
        meant = state.notes.select("perf_id", "date", "note_id", "seq").join(means.select("perf_id", F.col("date").cast("long").alias("date"), "_row", "_note", "mean"), ["perf_id", "date"])
        meant = meant.where(F.col("_note").isNull() | (F.col("_note") == F.col("note_id").cast("string")))
        clash = articulation.conflicts(state.notes, meant.select("perf_id", "note_id", "seq", "mean", "_row")).select("perf_id", "_row").distinct()
        found = found.join(clash.withColumn("_clash", F.lit(True)), ["perf_id", "_row"], "left").withColumn("conflict", F.coalesce("_clash", F.lit(False)))
        state = self._define(state, "articulationDef", defs, "rel_dur", "rel_vel")
        best = defs.where("is_default").select("perf_id", F.col("name").alias("default_articulation"), F.col("label").alias("_best"))
        named = found.where("label >= 0 AND NOT conflict").join(best, "perf_id").select("perf_id", "_row", F.concat(F.lit("def_"), F.col("label")).alias("_name"), (F.col("label") == F.col("_best")).alias("_gone"))
        rows = all_rows.join(named, ["perf_id", "_row"], "left").where(~F.coalesce("_gone", F.lit(False)))
        has = F.col("_name").isNotNull()
        rows = rows.withColumn("name_ref", F.coalesce("_name", "name_ref")).withColumn("rel_dur", F.when(~has, F.col("rel_dur"))).withColumn("rel_vel", F.when(~has, F.col("rel_vel")))
        state = state.with_table("articulation", rows.select(*state.table("articulation").columns))
        return self._style(state, "articulation", best.select("perf_id", "default_articulation"))


class InsertPedal(Stage):
    name = "InsertPedal"
    requires = ("TranslatePhysicalTimeToTicks",)
    defaults = {"pedal": None, "start": 0.0, "duration": 0.0, "direction": "down", "depth": 1.0}

    def transform(self, state: State) -> State:
        o = self.options
        rows = ops.pedal_movements(state.pedals, o["start"], o["duration"], o["direction"], o["depth"], o["pedal"])
        return state.inserted("movement", rows.withColumn("scope", F.lit(None).cast("int")))


class InsertMetadata(Stage):
    """Replace the metadata of every performance: authors, comments, related resources, and what made them."""

    name = "InsertMetadata"
    defaults = {"authors": (), "comments": (), "related_resources": (), "app_info": ()}

    def transform(self, state: State) -> State:
        o = self.options
        kinds = (("author", "authors"), ("comment", "comments"), ("relatedResource", "related_resources"), ("appInfo", "app_info"))
        if any(isinstance(o[key], Keyed) for _, key in kinds):
            return state.with_table("metadata", self._lines(state.meta, kinds))
        rows = [(kind, json.dumps(x, sort_keys=True)) for kind, key in kinds for x in o[key]]
        lines = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(kind).alias("kind"), F.lit(body).alias("body")) for k, (kind, body) in enumerate(rows)]) if rows else F.array().cast("array<struct<pos:int,kind:string,body:string>>")
        return state.with_table("metadata", state.meta.select("perf_id", F.explode(lines).alias("x")).select("perf_id", "x.pos", "x.kind", "x.body"))


    def _lines(self, meta: DataFrame, kinds: tuple) -> DataFrame:
        """Metadata of options that are arrays of JSON texts."""
        rows, *values = by_performance(meta.select("perf_id"), *[self.options[key] for _, key in kinds])
        of = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("body"))
        tagged = [F.transform(v, of(kind)) for (kind, _), v in zip(kinds, values, strict=True)]
        return rows.select("perf_id", F.posexplode(F.concat(*tagged)).alias("pos", "x")).select("perf_id", "pos", "x.kind", "x.body")


class InsertAsynchrony(Stage):
    name = "InsertAsynchrony"
    ranged = True
    defaults = {"part": 1, "start": 0, "end": 0}

    def transform(self, state: State) -> State:
        o = self.options
        shift, notes = ops.asynchrony(state.notes, o["part"], o["start"], o["end"])
        shift, part, start, end = by_performance(shift, o["part"], o["start"], o["end"])
        pair = F.array(*[F.struct(F.lit(at).cast("double").alias("date"), value.alias("milliseconds_offset")) for at, value in ((start, F.col("shift") * 1000), (end, F.lit(0.0)))])
        rows = shift.select("perf_id", F.explode(pair).alias("x")).select("perf_id", "x.date", "x.milliseconds_offset")
        rows, part = by_performance(with_ids(rows, "asynchrony", state.table("asynchrony")), o["part"])
        rows = rows.withColumn("scope", F.lit(part).cast("int"))
        return state.inserted("asynchrony", rows).with_notes(notes)


class MakeDefaultArticulation(Stage):
    name = "MakeDefaultArticulation"
    requires = ("TranslatePhysicalTimeToTicks",)
    defaults = {"scope": None}

    def transform(self, state: State) -> State:
        rows = scoped(state.table("articulation"), self.options["scope"])
        ids = F.transform("noteid", lambda x: F.regexp_replace(x, "^#", ""))
        mean, notes = ops.make_default_articulation(state.notes, rows.select("perf_id", F.col("date").cast("long").alias("date"), ids.alias("noteid")))
        mean = mean.withColumn("name", F.lit("default articulation"))
        state = self._define(state, "articulationDef", mean, "rel_dur").with_notes(notes)
        return self._style(state, "articulation", mean.select("perf_id", F.col("name").alias("default_articulation")))


class CompressOrnamentation(Stage):
    name = "CompressOrnamentation"
    requires = ("StylizeOrnamentation",)
    defaults = {"precision": 0}
    BODY = "frame_start double, frame_length double, intensity double, noteoff_shift string, time_unit string, transition_from double, transition_to double"

    def transform(self, state: State) -> State:
        d = state.table("definitions")
        own = d.where("def_type = 'ornamentDef'").select("perf_id", "scope", "def_type", "name", F.from_json("body", self.BODY).alias("b")).select("perf_id", "scope", "def_type", "name", "b.*")
        own = ornaments.compressed(own, self.options["precision"])
        fields = [x.split()[0] for x in self.BODY.split(", ")]
        own = own.select("perf_id", "scope", "def_type", "name", F.to_json(F.struct(*fields)).alias("body"))
        return state.with_table("definitions", d.where("def_type <> 'ornamentDef'").unionByName(own))


class InterpolateTimingImprecision(Stage):
    """Computes limits and inserts nothing."""

    name = "InterpolateTimingImprecision"
    defaults = {"predefined": 0.0}

    def limits(self) -> tuple[float, float]:
        return ops.imprecision_limits(self.options["predefined"])

    def transform(self, state: State) -> State:
        return state


STANDARD = (
    MakeChoice, Modify, InsertTemporalSpread, InsertDynamicsGradient, ApproximateLogarithmicTempo, TranslatePhysicalTimeToTicks, StylizeOrnamentation, InsertRubato,
    CombineAdjacentRubatos, InsertDynamicsInstructions, InsertMetricalAccentuation, MergeMetricalAccentuations, InsertArticulation, StylizeArticulation, InsertPedal, InsertMetadata,
    InsertAsynchrony, MakeDefaultArticulation, CompressOrnamentation, InterpolateTimingImprecision,
)
for _stage in STANDARD:
    registry.register(_stage)

__all__ = ["STANDARD", "Stage", "registry", "with_ids"]
