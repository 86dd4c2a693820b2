"""How queries are registered, and the derived tables as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The derived tables of tactuslab.sources.derived.
TABLES = """
WITH RECURSIVE ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events),
notes AS (SELECT user_id AS perf_id, event_id AS note_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 2 END AS part,
  CAST((us // 43200000000) * 720 AS BIGINT) AS date, CAST(360 * (1 + event_id % 4) AS BIGINT) AS duration, us / 43200000000.0::DOUBLE AS onset,
  0.25::DOUBLE + (event_id % 8) * 0.125::DOUBLE AS midi_duration, CAST(48 + event_id % 37 AS INTEGER) AS midi_pitch,
  least(127.0::DOUBLE, 1 + floor(value)) AS velocity, event_type AS source FROM ev),
takes AS (SELECT * REPLACE (CAST(720 AS BIGINT) AS duration, CAST(48 + note_id % 3 AS INTEGER) AS midi_pitch) FROM notes),
pedals AS (SELECT perf_id, note_id AS pedal_id, CASE source WHEN 'error' THEN 'sustain' ELSE 'soft' END AS type, onset, midi_duration, source FROM notes WHERE source IN ('error', 'signup')),
chords AS (SELECT perf_id, date, count(*) AS n_notes, arg_min(onset, seq) AS first_onset, avg(velocity) AS mean_velocity, avg(onset) AS mean_onset FROM notes GROUP BY ALL)
"""


def fx(x: str, digits: int = 6) -> str:
    """x in whole units of ten to the -digits."""
    return f"CAST(floor(({x}) * {float(10**digits)}::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL over the derived tables for the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else TABLES + sql
        return f

    return register
