"""Tables of a corpus of performances. Every table leads with perf_id, which everything partitions by.

A performance has two clocks: score time in ticks, 720 a quarter, and physical time in seconds.
seq keeps the order of a performance's notes: it breaks ties wherever the first of several counts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PPQ = 720
WHOLE = 4 * PPQ

NOTES = (
    "perf_id long, note_id string, seq long, part int, date long, duration long, pitchname string, accidentals int, octave int, midi_pitch int, "
    "onset double, midi_duration double, velocity double, source string, tick_date double, tick_duration double, abs_vel_change double, attrs map<string,string>"
)
PEDALS = "perf_id long, seq long, pedal_id string, type string, date long, date_end long, onset double, midi_duration double, tick_date double, tick_duration double, source string"
META = "perf_id long, ts_numerator int, ts_denominator int"

#: Columns of each kind of instruction after perf_id, scope (null: all parts), id and date.
INSTRUCTIONS = {
    "tempo": "bpm double, beat_length double, transition_to double, mean_tempo_at double",
    "dynamics": "volume double, transition_to double, curvature double, protraction double",
    "ornament": "name_ref string, note_order string, frame_start double, frame_length double, time_unit string, noteoff_shift string, intensity double, transition_from double, transition_to double, scale double",
    "rubato": "frame_length double, intensity double, late_start double, early_end double, loop boolean",
    "articulation": "noteid array<string>, name_ref string, rel_dur double, rel_vel double, abs_dur double, abs_dur_change double",
    "accentuation_pattern": "name_ref string, scale double, loop boolean",
    "movement": "position double, transition_to double, controller string",
    "asynchrony": "milliseconds_offset double",
}
DEFINITIONS = "perf_id long, scope int, def_type string, name string, body string"
STYLES = "perf_id long, scope int, map_type string, id string, date double, name_ref string, default_articulation string"
METADATA = "perf_id long, pos int, kind string, body string"
PROVENANCE = "perf_id long, transformer_id string, instruction_id string, corresp array<string>"


def instruction_schema(kind: str) -> str:
    return f"perf_id long, scope int, id string, date double, {INSTRUCTIONS[kind]}"


@dataclass(frozen=True)
class State:
    """What a chain of stages passes on: residual notes and pedals, and the tables explained so far."""

    notes: DataFrame
    pedals: DataFrame
    meta: DataFrame
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.notes.sparkSession

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        fixed = {"definitions": DEFINITIONS, "styles": STYLES, "metadata": METADATA, "provenance": PROVENANCE}
        return self.spark.createDataFrame([], fixed.get(name) or instruction_schema(name))

    def with_table(self, name: str, df: DataFrame) -> State:
        return replace(self, tables={**self.tables, name: df})

    def inserted(self, name: str, rows: DataFrame) -> State:
        """With more rows in a table; columns that they lack are null."""
        have = self.table(name)
        return self.with_table(name, have.unionByName(rows, allowMissingColumns=True).select(*have.columns))

    def with_notes(self, notes: DataFrame) -> State:
        return replace(self, notes=notes)


@dataclass(frozen=True)
class Keyed:
    """An option with a value for each performance: a column over a table with one row a performance."""

    table: DataFrame
    name: str
    value: Column

    def either(self, other: Keyed) -> Keyed:
        """This option, or where it is null another of the same table."""
        return Keyed(self.table, f"{self.name}_{other.name}", F.coalesce(self.value, other.value))


def by_performance(rows: DataFrame, *options: Any) -> tuple:
    """rows beside the columns that keyed options need, and each option as it can be used there: keyed ones as columns, others as they are.

    Columns already there from an earlier call aren't joined again.
    """
    keyed = {f"_o_{o.name}": o for o in options if isinstance(o, Keyed)}
    new = {c: o for c, o in keyed.items() if c not in rows.columns}
    if new:
        table = next(iter(new.values())).table
        rows = rows.join(table.select("perf_id", *[o.value.alias(c) for c, o in new.items()]), "perf_id")
    return rows, *[F.col(f"_o_{o.name}") if isinstance(o, Keyed) else o for o in options]


def in_scope(scope: int | Column | None, part: str = "part") -> Column:
    """Whether a note belongs to a scope: null means all parts, a number the part one above it."""
    if isinstance(scope, Column):
        return scope.isNull() | (F.col(part) - 1 == scope)
    return F.lit(True) if scope is None else F.col(part) - 1 == scope


def within(start: Any, end: Any, at: str = "date") -> Column:
    """Whether a date lies in a closed range; a range without a start holds all."""
    if isinstance(start, Column):
        return start.isNull() | F.col(at).between(start, end)
    return F.lit(True) if start is None else F.col(at).between(start, end)


def listed(ids: Any, column: str = "note_id") -> Column:
    """Whether a column's value is among ids, which are a list or an array of strings."""
    return F.coalesce(F.array_contains(ids, F.col(column).cast("string")), F.lit(False)) if isinstance(ids, Column) else F.col(column).isin(list(ids))


def defined(column: Column | str) -> Column:
    """Neither null nor NaN."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c)


def scoped(rows: DataFrame, scope: int | Keyed | None, others: bool = False) -> DataFrame:
    """Instructions of exactly one scope: a part's lookup doesn't fall back to the global ones. With others all but these."""
    both, own = by_performance(rows, scope)
    same = F.col("scope").eqNullSafe(F.lit(own).cast("int"))
    return both.where(~same if others else same).select(*rows.columns)
