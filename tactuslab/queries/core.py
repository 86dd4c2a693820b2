"""Scans, lookups, edits, chords, windows and tempo points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactuslab.functions.kernels import fixed
from tactuslab.operators import notes as ops
from tactuslab.operators import relops, tempo
from tactuslab.queries.base import ORACLES, fx, query
from tactuslab.sources import derived


@query(f"SELECT perf_id, note_id, part, date, duration, {fx('onset')} AS onset_u, {fx('midi_duration')} AS midi_duration_u, midi_pitch, velocity, source FROM notes")
def notes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    return n.select("perf_id", "note_id", "part", "date", "duration", fixed(F.col("onset")).alias("onset_u"), fixed(F.col("midi_duration")).alias("midi_duration_u"), "midi_pitch", "velocity", "source")


@query("SELECT perf_id, note_id, date FROM notes WHERE date = 7200")
def notes_at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.at_date(derived.notes(spark, sf_dir), 7200).select("perf_id", "note_id", "date")


@query("SELECT perf_id, note_id, date, part FROM notes WHERE part - 1 = 1")
def notes_in_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.in_part(derived.notes(spark, sf_dir), 1).select("perf_id", "note_id", "date", "part")


@query("SELECT perf_id, note_id, date FROM notes WHERE date BETWEEN 7200 AND 14400 AND part = 1")
def notes_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.in_range(derived.notes(spark, sf_dir), 7200, 14400, 0).select("perf_id", "note_id", "date")


@query("SELECT perf_id, note_id, midi_pitch FROM notes WHERE note_id IN (3, 14, 159, 265)")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.by_id(derived.notes(spark, sf_dir), [3, 14, 159, 265]).select("perf_id", "note_id", "midi_pitch")


@query("SELECT note_id, coalesce(CASE WHEN note_id = 14 THEN 'yes' END, 'no') AS marked FROM notes")
def custom_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir).withColumn("attrs", F.lit(None).cast("map<string,string>"))
    return ops.with_attributes(n, 14, {"marked": "yes"}).select("note_id", F.coalesce(F.col("attrs")["marked"], F.lit("no")).alias("marked"))


@query("SELECT DISTINCT perf_id, part - 1 AS scope FROM notes")
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.parts(derived.notes(spark, sf_dir))


@query("SELECT perf_id, max(date) AS last_date, max(date + duration) AS end_date FROM notes GROUP BY perf_id")
def last_date_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extent(derived.notes(spark, sf_dir))


@query("SELECT perf_id, arg_min(note_id, seq) AS note_id, max(date) AS date FROM notes JOIN (SELECT perf_id, max(date) AS d FROM notes GROUP BY perf_id) USING (perf_id) WHERE date = d GROUP BY perf_id")
def last_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_note(derived.notes(spark, sf_dir))


@query("SELECT perf_id, min(date) AS from_date, max(date) AS to_date FROM notes WHERE note_id % 50 = 0 AND note_id < 2000 GROUP BY perf_id")
def range_of_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.range_of(derived.notes(spark, sf_dir), note_ids=list(range(0, 2000, 50)))


@query(f"""SELECT kind, id, {fx('onset')} AS onset_u, {fx('midi_duration')} AS midi_duration_u FROM (
  SELECT 'note' AS kind, note_id AS id, onset - m AS onset, midi_duration FROM notes JOIN (SELECT perf_id, min(onset) AS m FROM notes GROUP BY perf_id) USING (perf_id)
  UNION ALL SELECT 'pedal', pedal_id, CASE WHEN onset < m THEN 0 ELSE onset - coalesce(m, 0) END, CASE WHEN onset < m THEN midi_duration - (m - onset) ELSE midi_duration END
  FROM pedals LEFT JOIN (SELECT perf_id, min(onset) AS m FROM notes GROUP BY perf_id) USING (perf_id))""")
def shift_first_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifted(derived.notes(spark, sf_dir), derived.pedals(spark, sf_dir))


@query(ORACLES["shift_first_onset"])
def shift_first_onset_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift_first_onset(spark, sf_dir)


def _shifted(notes: DataFrame, pedals: DataFrame) -> DataFrame:
    n, p = ops.shift_to_first_onset(notes, pedals)
    out = lambda df, kind, i: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), fixed(F.col("onset")).alias("onset_u"), fixed(F.col("midi_duration")).alias("midi_duration_u"))
    return out(n, "note", "note_id").unionByName(out(p, "pedal", "pedal_id"))


def _modified(aspect: str, column: str, change: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = ops.modify(derived.notes(spark, sf_dir), aspect, change, 3600, 21600, scope=1)
        return n.select("note_id", fixed(F.col(column)).alias("value_u"))

    run.__name__ = f"modify_{aspect}"
    value = f"greatest(0, {column} + ({change}))" if aspect == "velocity" else f"{column} + ({change})"
    return query(f"SELECT note_id, {fx(f'CASE WHEN date BETWEEN 3600 AND 21600 AND part = 2 THEN {value} ELSE {column} END')} AS value_u FROM notes")(run)


_modified("velocity", "velocity", -20.0)
_modified("onset", "onset", 0.25)
_modified("duration", "midi_duration", 0.5)


@query(f"SELECT perf_id, date, n_notes, {fx('first_onset')} AS first_onset_u, {fx('mean_velocity')} AS mean_velocity_u FROM chords")
def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.chords(derived.notes(spark, sf_dir)).select("perf_id", "date", "n_notes", fixed(F.col("first_onset")).alias("first_onset_u"), fixed(F.col("mean_velocity")).alias("mean_velocity_u"))


@query("SELECT perf_id, date, part - 1 AS scope, count(*) AS n_notes, arg_min(note_id, seq) AS first_note FROM notes GROUP BY ALL")
def chords_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.notes(spark, sf_dir).groupBy("perf_id", "date", (F.col("part") - 1).alias("scope")).agg(F.count(F.lit(1)).alias("n_notes"), F.min_by("note_id", "seq").alias("first_note"))


@query(f"SELECT perf_id, date, {fx('CASE date WHEN 7200 THEN 64 ELSE mean_velocity END')} AS velocity_u FROM chords")
def phantom_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tactuslab.operators import dynamics

    return dynamics.points(derived.notes(spark, sf_dir), {7200: 64.0, 14400: 0.0}).select("perf_id", "date", fixed(F.col("velocity")).alias("velocity_u"))


def _choice_sql(affected: str, velocity: str | None = None) -> str:
    v = f"coalesce(arg_min(velocity, seq) FILTER (WHERE a AND source = '{velocity}') OVER g, velocity)" if velocity else "velocity"
    return f"""SELECT note_id, velocity FROM (SELECT note_id, seq, a, k, CASE WHEN k = seq THEN v ELSE velocity END AS velocity FROM (
  SELECT *, CASE WHEN a THEN min(seq) FILTER (WHERE source = 'view') OVER g END AS k, {v} AS v FROM (SELECT *, {affected} AS a FROM takes)
  WINDOW g AS (PARTITION BY perf_id, a, date, duration, midi_pitch))) WHERE k IS NULL OR k = seq"""


def _takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.notes(spark, sf_dir, pitches=3, fixed_duration=True)


@query(_choice_sql("true"))
def make_choice_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.make_choice(_takes(spark, sf_dir), "view").select("note_id", "velocity")


@query(_choice_sql("date BETWEEN 7200 AND 28800"))
def make_choice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.make_choice(_takes(spark, sf_dir), "view", start=7200, end=28800).select("note_id", "velocity")


@query(_choice_sql("note_id < 3000"))
def make_choice_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.make_choice(_takes(spark, sf_dir), "view", note_ids=list(range(3000))).select("note_id", "velocity")


@query(_choice_sql("true", "click"))
def choice_velocity_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.make_choice(_takes(spark, sf_dir), "view", velocity="click").select("note_id", "velocity")


@query("SELECT pedal_id, type FROM pedals WHERE source = 'error'")
def pedal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.choose_pedals(derived.pedals(spark, sf_dir), "error").select("pedal_id", "type")


_PAIRS = """, heads AS (SELECT perf_id, date, first_onset AS onset, min(date) OVER w AS d0, first_value(first_onset) OVER (PARTITION BY perf_id ORDER BY date) AS o0 FROM chords WINDOW w AS (PARTITION BY perf_id)),
pairs AS (SELECT perf_id, date, date - d0 AS rel_date, onset - o0 AS rel_onset FROM heads),
steps AS (SELECT *, date - lag(date) OVER w AS dt, (rel_onset - lag(rel_onset) OVER w) * 1000 AS dms, lag(date) OVER w AS before FROM pairs WINDOW w AS (PARTITION BY perf_id ORDER BY date)),
points AS (SELECT perf_id, date, (date + before) / 2.0::DOUBLE AS mid, 60000.0::DOUBLE * dt / (dms * 720) AS bpm, least(1.0::DOUBLE, dt / 720.0::DOUBLE) AS weight FROM steps WHERE dt > 0 AND dms > 0)
"""


@query(_PAIRS + f"SELECT perf_id, date, {fx('rel_onset')} AS onset_u, rel_date FROM pairs")
def onset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tempo.onset_pairs(derived.notes(spark, sf_dir))
    return p.select("perf_id", "date", fixed(F.col("rel_onset")).alias("onset_u"), "rel_date")


@query(_PAIRS + f"SELECT perf_id, date, {fx('mid')} AS mid_u, {fx('bpm')} AS bpm_u, {fx('weight')} AS weight_u FROM points WHERE bpm BETWEEN 5 AND 600")
def ioi_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tempo.tempo_points(tempo.onset_pairs(derived.notes(spark, sf_dir)))
    return p.select("perf_id", "date", fixed(F.col("mid")).alias("mid_u"), fixed(F.col("bpm")).alias("bpm_u"), fixed(F.col("weight")).alias("weight_u"))


@query(f"""SELECT perf_id, date, {fx('onset')} AS onset_u, silent FROM (
  SELECT coalesce(c.perf_id, s.perf_id) AS perf_id, coalesce(c.date, s.date) AS date, coalesce(s.onset, first_onset) AS onset, s.onset IS NOT NULL AS silent
  FROM (SELECT * FROM chords WHERE date BETWEEN 0 AND 36000) c FULL JOIN (SELECT DISTINCT perf_id, d AS date, d / 720.0::DOUBLE + 0.125 AS onset FROM notes, unnest([3600, 7200, 10800]) AS u(d)) s ON c.perf_id = s.perf_id AND c.date = s.date)""")
def silent_onset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    silent = n.select("perf_id").distinct().select("perf_id", F.explode(F.array(*[F.lit(d).cast("long") for d in (3600, 7200, 10800)])).alias("date")).withColumn("onset", F.col("date") / 720.0 + 0.125)
    return tempo.merged_onsets(n, silent, 0, 36000).select("perf_id", "date", fixed(F.col("onset")).alias("onset_u"), "silent")


@query(f"""SELECT perf_id, boundary, {fx('CASE WHEN b IS NULL THEN oa WHEN a IS NULL THEN ob WHEN a = b THEN oa ELSE oa + (boundary - a) * (ob - oa) / (b - a) END')} AS onset_u FROM (
  SELECT c.perf_id, boundary, max(date) FILTER (WHERE date <= boundary) AS a, min(date) FILTER (WHERE date >= boundary) AS b,
  arg_max(first_onset, date) FILTER (WHERE date <= boundary) AS oa, arg_min(first_onset, date) FILTER (WHERE date >= boundary) AS ob
  FROM chords c, unnest([0, 5000, 12345, 99999999]) AS u(boundary) GROUP BY ALL)""")
def boundary_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tempo.boundary_times(derived.notes(spark, sf_dir), [0, 5000, 12345, 99999999])
    return b.select("perf_id", "boundary", fixed(F.col("onset")).alias("onset_u"))


@query(_PAIRS + f"""SELECT perf_id, n, {fx('slope', 5)} AS slope_u, {fx('icpt', 4)} AS intercept_u FROM (SELECT perf_id, count(*) AS n,
  (sum(weight) * sum(weight * x * bpm) - sum(weight * x) * sum(weight * bpm)) / nullif(sum(weight) * sum(weight * x * x) - sum(weight * x) * sum(weight * x), 0) AS slope,
  (sum(weight * bpm) * sum(weight * x * x) - sum(weight * x) * sum(weight * x * bpm)) / nullif(sum(weight) * sum(weight * x * x) - sum(weight * x) * sum(weight * x), 0) AS icpt
  FROM (SELECT *, mid / 720 AS x FROM points WHERE bpm BETWEEN 5 AND 600) GROUP BY perf_id)""")
def wls_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tempo.tempo_points(tempo.onset_pairs(derived.notes(spark, sf_dir)))
    return tempo.regression(p).select("perf_id", "n", fixed(F.col("slope"), 5).alias("slope_u"), fixed(F.col("intercept"), 4).alias("intercept_u"))


@query(_PAIRS + "SELECT perf_id, date, CASE WHEN mid >= 36000 THEN 2 WHEN mid >= 18000 THEN 1 ELSE 0 END AS segment FROM points WHERE bpm BETWEEN 5 AND 600 AND mid BETWEEN 7200 AND 43200")
def partition_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tempo.tempo_points(tempo.onset_pairs(derived.notes(spark, sf_dir)))
    return tempo.partitioned(p, [7200, 18000, 36000, 43200]).select("perf_id", "date", "segment")


@query("""SELECT DISTINCT perf_id, a, b, from_date FROM (SELECT perf_id, sum(brk) OVER (PARTITION BY perf_id ORDER BY date DESC) AS isl, date, date AS a, e AS b, last_value(date) OVER (PARTITION BY perf_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x, min(date) FILTER (WHERE ok) OVER (PARTITION BY perf_id) AS from_date, ok FROM (
  SELECT *, sum(brk) OVER (PARTITION BY perf_id ORDER BY date DESC) = 0 AS ok FROM (SELECT *, CASE WHEN date < 36000 AND e <> coalesce(lead(date) OVER (PARTITION BY perf_id ORDER BY date), 36000) THEN 1 ELSE 0 END AS brk FROM (
  SELECT perf_id, date, date + 720 AS e FROM chords WHERE date < 36000)))) WHERE ok""")
def chain_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relops.chords(derived.notes(spark, sf_dir)).where("date < 36000").select("perf_id", "date", (F.col("date") + 720).alias("end_date"), F.lit(0.25).alias("beat_length"))
    chain = tempo.chain_before(c, 36000, 0.25)
    return chain.withColumn("from_date", F.min("date").over(Window.partitionBy("perf_id"))).select("perf_id", F.col("date").alias("a"), F.col("end_date").alias("b"), "from_date")


@query("""SELECT perf_id, date, CASE WHEN date = 20000 THEN 'restored' ELSE 'kept' END AS state FROM (SELECT perf_id, date FROM chords WHERE NOT (date >= 10000 AND date < 20000)
  UNION SELECT perf_id, 20000 FROM chords c WHERE date < 20000 GROUP BY perf_id HAVING count(*) FILTER (WHERE date >= 10000 AND date < 20000) > 0)""")
def tempo_replace_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relops.chords(derived.notes(spark, sf_dir)).select("perf_id", F.col("date").cast("double").alias("date"), F.lit(60.0).alias("bpm"))
    out = tempo.replaced(c, [(10000, 20000)])
    return out.select("perf_id", F.col("date").cast("long").alias("date"), F.when(F.col("restored"), "restored").otherwise("kept").alias("state"))


@query(f"""SELECT perf_id, date, {fx('CASE WHEN has THEN first_onset * 1000 ELSE base + (date - bdate) * 1000.0 / 720 END', 3)} AS begin_u FROM (
  SELECT perf_id, g.date, c.date IS NOT NULL AND g.date > 0 AS has, c.first_onset,
    coalesce(last_value(CASE WHEN g.date > 0 THEN c.first_onset * 1000 END IGNORE NULLS) OVER w, 0) AS base,
    coalesce(last_value(CASE WHEN g.date > 0 THEN c.date END IGNORE NULLS) OVER w, 0) AS bdate
  FROM (SELECT DISTINCT perf_id, d AS date FROM notes, unnest(range(0, 50000, 3600)) AS u(d)) g LEFT JOIN chords c USING (perf_id, date) WINDOW w AS (PARTITION BY perf_id ORDER BY g.date))""")
def ms_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tactuslab.operators import ticks

    n = derived.notes(spark, sf_dir)
    grid = n.select("perf_id").distinct().select("perf_id", F.explode(F.sequence(F.lit(0), F.lit(49999), F.lit(3600))).alias("date")).withColumn("date", F.col("date").cast("double"))
    grid = grid.select("*", F.lit(60.0).alias("bpm"), F.lit(0.25).alias("beat_length"), F.lit(None).cast("double").alias("transition_to"), F.lit(None).cast("double").alias("mean_tempo_at"))
    return ticks.frames(grid, n).select("perf_id", F.col("date").cast("long").alias("date"), fixed(F.col("begin_ms"), 3).alias("begin_u"))
