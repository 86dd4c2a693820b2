"""Stages of the chain, over the derived performances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.functions import kernels
from tactuslab.functions.kernels import fixed
from tactuslab.operators import accentuation, articulation, dynamics, ornaments, relops, rubato, tempo, ticks
from tactuslab.operators import notes as ops
from tactuslab.queries.base import ORACLES, fx, query
from tactuslab.sources import derived

# ---------------------------------------------------------------- ornaments

_SPREAD = """, o AS (SELECT *, onset + midi_duration AS off, row_number() OVER (PARTITION BY perf_id, date ORDER BY onset, seq) AS k FROM notes),
o2 AS (SELECT *, row_number() OVER (PARTITION BY perf_id, date ORDER BY off, k) AS by_off, sign(midi_pitch - lag(midi_pitch) OVER w) AS dir, abs(lag(off) OVER w - onset) AS gap FROM o WINDOW w AS (PARTITION BY perf_id, date ORDER BY k)),
sp AS (SELECT perf_id, date, count(*) AS n, min(onset) AS first, max(onset) AS last, avg(onset) AS mean, min(dir) AS lo, max(dir) AS hi, bool_and(k = by_off) AS same, bool_and(coalesce(gap <= 0.02, true)) AS mono,
  arg_max(off, k) - arg_min(off, k) AS doff, string_agg('#' || note_id, ' ' ORDER BY k) AS ids FROM o2 GROUP BY ALL HAVING count(*) > 1 AND (max(onset) - min(onset)) * 1000 > 35)
"""


@query(_SPREAD + f"SELECT perf_id, date, n, {fx('(last - first) * 1000', 3)} AS length_u, {fx('(first - mean) * 1000', 3)} AS start_u FROM sp")
def spread_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ornaments.spread_chords(derived.notes(spark, sf_dir), with_intensity=False)
    return c.select("perf_id", "date", "n", fixed(F.col("frame_length"), 3).alias("length_u"), fixed((F.col("first") - F.col("mean")) * 1000, 3).alias("start_u"))


@query(_SPREAD + "SELECT perf_id, date, CASE WHEN lo = hi AND lo = 1 THEN 'ascending pitch' WHEN lo = hi AND lo = -1 THEN 'descending pitch' ELSE ids END AS note_order FROM sp")
def spread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ornaments.spread_chords(derived.notes(spark, sf_dir), with_intensity=False).select("perf_id", "date", "note_order")


@query(_SPREAD + "SELECT perf_id, date, CASE WHEN mono THEN 'monophonic' WHEN same AND doff > (last - first) * 0.8 THEN 'true' ELSE 'false' END AS noteoff_shift FROM sp")
def spread_noteoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ornaments.spread_chords(derived.notes(spark, sf_dir), with_intensity=False).select("perf_id", "date", "noteoff_shift")


def _applied(placement: str, value: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, moved = ornaments.temporal_spread(derived.notes(spark, sf_dir), placement)
        return moved.select("note_id", fixed(F.col("onset")).alias("onset_u"))

    run.__name__ = f"spread_apply_{placement.replace('-', '_')}"
    return query(_SPREAD + f"SELECT note_id, {fx(f'coalesce({value}, onset)')} AS onset_u FROM notes LEFT JOIN sp USING (perf_id, date)")(run)


_applied("estimate", "mean")
_applied("on-beat", "first")
_applied("before-beat", "last")

_GOLD = 1.618033988749895


@query(
    _SPREAD
    + f""", x AS (SELECT perf_id, date, list((onset - first) / (last - first) ORDER BY k) AS o FROM o JOIN sp USING (perf_id, date) GROUP BY ALL),
g AS (SELECT perf_id, date, o, 0.1::DOUBLE AS lo, 5.0::DOUBLE AS hi, 0 AS k FROM x WHERE len(o) > 2 UNION ALL
  SELECT perf_id, date, o, CASE WHEN ec < ed THEN lo ELSE c END, CASE WHEN ec < ed THEN d ELSE hi END, k + 1 FROM (
    SELECT *, list_sum(list_transform(range(1, len(o) + 1), lambda i: (o[i] - ((i - 1) / (len(o) - 1)::DOUBLE) ** c) ** 2)) AS ec, list_sum(list_transform(range(1, len(o) + 1), lambda i: (o[i] - ((i - 1) / (len(o) - 1)::DOUBLE) ** d) ** 2)) AS ed
    FROM (SELECT *, hi - (hi - lo) / {_GOLD}::DOUBLE AS c, lo + (hi - lo) / {_GOLD}::DOUBLE AS d FROM g WHERE k < 33)))
SELECT perf_id, date, {fx('(lo + hi) / 2', 3)} AS intensity_u FROM g WHERE k = 33 UNION ALL SELECT perf_id, date, 1000 FROM x WHERE len(o) <= 2"""
)
def spread_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ornaments.spread_chords(derived.notes(spark, sf_dir)).select("perf_id", "date", fixed(F.col("intensity"), 3).alias("intensity_u"))


_GRADIENT = """, gr AS (SELECT perf_id, date, v0, v1, CASE WHEN v1 > v0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS a, CASE WHEN v1 > v0 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS b FROM (
  SELECT perf_id, date, arg_min(velocity, (onset, seq)) AS v0, arg_max(velocity, (onset, seq)) AS v1, count(*) AS n FROM {src} GROUP BY ALL) WHERE n > 1 AND v0 <> v1),
gs AS (SELECT *, (v1 - v0) / (b - a) AS scale, v0 - a * (v1 - v0) / (b - a) AS standard FROM gr)
"""
_SORTED = """, sv AS (SELECT * REPLACE (CASE WHEN rises THEN up[k] ELSE up[len(up) + 1 - k] END AS velocity) FROM (
  SELECT *, row_number() OVER w AS k, list(velocity) OVER (PARTITION BY perf_id, date ORDER BY velocity, onset, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS up,
    arg_min(kk, (-velocity, kk)) OVER c > arg_min(kk, (velocity, kk)) OVER c AS rises FROM (SELECT *, row_number() OVER (PARTITION BY perf_id, date ORDER BY onset, seq) AS kk FROM notes)
  WINDOW w AS (PARTITION BY perf_id, date ORDER BY onset, seq), c AS (PARTITION BY perf_id, date)))
"""


@query(_GRADIENT.format(src="notes") + f"SELECT perf_id, date, {fx('a')} AS from_u, {fx('b')} AS to_u, {fx('scale')} AS scale_u, {fx('standard')} AS standard_u FROM gs")
def gradient_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, _ = ornaments.dynamics_gradient(derived.notes(spark, sf_dir))
    return o.select("perf_id", "date", fixed(F.col("transition_from")).alias("from_u"), fixed(F.col("transition_to")).alias("to_u"), fixed(F.col("scale")).alias("scale_u"), fixed(F.col("standard")).alias("standard_u"))


@query(_SORTED + "SELECT note_id, velocity FROM sv")
def gradient_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ornaments.sorted_velocities(derived.notes(spark, sf_dir)).select("note_id", "velocity")


@query(_GRADIENT.format(src="notes") + f"SELECT note_id, {fx('coalesce(standard, velocity)')} AS velocity_u FROM notes LEFT JOIN gs USING (perf_id, date)")
def gradient_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = ornaments.dynamics_gradient(derived.notes(spark, sf_dir))
    return n.select("note_id", fixed(F.col("velocity")).alias("velocity_u"))


# ---------------------------------------------------------------- tempo and ticks

_ENDS = ", ends AS (SELECT perf_id, max(date + duration) AS e FROM notes GROUP BY perf_id)"
#: A tempo every 3600 ticks, 54, 60 and 66 beats a minute in turn.
_TEMPOS = _ENDS + """, tempos AS (SELECT perf_id, d::DOUBLE AS date, 54.0::DOUBLE + 6 * ((d // 3600) % 3) AS bpm FROM ends, unnest(range(0, 60000, 3600)) AS u(d) WHERE d < e),
fr AS (SELECT perf_id, date, bpm, coalesce(lead(date) OVER w, e::DOUBLE) AS end_date, lead(date) OVER w IS NULL AS is_last, row_number() OVER w AS k FROM tempos JOIN ends USING (perf_id) WINDOW w AS (PARTITION BY perf_id ORDER BY date)),
fl AS (SELECT f.*, 15000.0::DOUBLE * (end_date - f.date) / (bpm * 0.25 * 720) AS len, CASE WHEN k > 1 THEN c.first_onset * 1000 END AS anchor FROM fr f LEFT JOIN chords c ON c.perf_id = f.perf_id AND c.date = f.date),
fi AS (SELECT *, count(anchor) OVER (PARTITION BY perf_id ORDER BY k) AS isl FROM fl),
fb AS (SELECT *, coalesce(first_value(anchor) OVER i, 0) + coalesce(sum(len) OVER (PARTITION BY perf_id, isl ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_ms FROM fi WINDOW i AS (PARTITION BY perf_id, isl ORDER BY k)),
fh AS (SELECT b.*, coalesce(CASE WHEN is_last THEN c.first_onset * 1000 ELSE lead(anchor) OVER (PARTITION BY b.perf_id ORDER BY k) END - begin_ms, len) AS heard FROM fb b LEFT JOIN chords c ON c.perf_id = b.perf_id AND c.date = b.end_date),
td AS (SELECT n.*, f.date + ((n.onset * 1000 - f.begin_ms) / 1000.0::DOUBLE * (f.bpm * 0.25 * 4 / 60)) * 720 AS tick_date FROM notes n LEFT JOIN fh f ON f.perf_id = n.perf_id AND n.date >= f.date AND (n.date < f.end_date OR f.is_last)),
tn AS (SELECT td.*, x.tick_end - td.tick_date AS tick_duration FROM td LEFT JOIN (
  SELECT t.note_id, arg_max(f.date + (((t.onset + t.midi_duration) * 1000 - f.begin_ms) / 1000.0::DOUBLE * (f.bpm * 0.25 * 4 / 60)) * 720, f.begin_ms) AS tick_end
  FROM td t JOIN fh f ON f.perf_id = t.perf_id AND (t.onset + t.midi_duration) * 1000 >= f.begin_ms AND (t.onset + t.midi_duration) * 1000 - f.begin_ms <= f.heard
  JOIN (SELECT t.note_id, max(f.begin_ms) AS b FROM td t JOIN fh f ON f.perf_id = t.perf_id AND (t.onset + t.midi_duration) * 1000 >= f.begin_ms GROUP BY 1) l ON l.note_id = t.note_id AND l.b = f.begin_ms
  GROUP BY 1) x USING (note_id))
"""


def _tempos(spark: SparkSession, sf_dir: str, n: DataFrame) -> DataFrame:
    rows = relops.ends(n).select("perf_id", "end_date", F.explode(F.sequence(F.lit(0), F.lit(59999), F.lit(3600))).alias("d")).where("d < end_date")
    none = F.lit(None).cast("double")
    return rows.select("perf_id", F.col("d").cast("double").alias("date"), (54.0 + 6 * ((F.col("d") / 3600).cast("int") % 3)).alias("bpm"), F.lit(0.25).alias("beat_length"), none.alias("transition_to"), none.alias("mean_tempo_at"))


def _ticked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    t = _tempos(spark, sf_dir, n)
    frames = relops.saved(ticks.frames(t, n), "frames")
    return ticks.tick_durations(ticks.tick_onsets(n, t, frames), t, frames)


@query(_ENDS + f"SELECT note_id, {fx('onset * 720', 4)} AS tick_date_u FROM notes")
def tick_onset_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    return ticks.tick_onsets(n, derived.constant_tempo(spark, sf_dir)).select("note_id", fixed(F.col("tick_date"), 4).alias("tick_date_u"))


@query(_TEMPOS + f"SELECT note_id, {fx('tick_date', 4)} AS tick_date_u FROM td")
def tick_onset_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    return ticks.tick_onsets(n, _tempos(spark, sf_dir, n)).select("note_id", fixed(F.col("tick_date"), 4).alias("tick_date_u"))


@query(_TEMPOS + f"SELECT note_id, {fx('tick_duration', 3)} AS tick_duration_u FROM tn")
def tick_duration_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticked(spark, sf_dir).select("note_id", fixed(F.col("tick_duration"), 3).alias("tick_duration_u"))


@query(
    _TEMPOS
    + f"""SELECT pedal_id, {fx('a', 3)} AS tick_date_u, {fx('b - a', 3)} AS tick_duration_u FROM (SELECT p.pedal_id,
  max(CASE WHEN p.onset * 1000 >= f.begin_ms AND p.onset * 1000 < f.begin_ms + f.len AND fa.b = f.begin_ms THEN f.date + ((p.onset * 1000 - f.begin_ms) / 1000.0::DOUBLE * (f.bpm * 0.25 * 4 / 60)) * 720 END) AS a,
  max(CASE WHEN (p.onset + p.midi_duration) * 1000 >= f.begin_ms AND (p.onset + p.midi_duration) * 1000 < f.begin_ms + f.heard AND fb2.b = f.begin_ms THEN f.date + (((p.onset + p.midi_duration) * 1000 - f.begin_ms) / 1000.0::DOUBLE * (f.bpm * 0.25 * 4 / 60)) * 720 END) AS b
  FROM pedals p JOIN fh f USING (perf_id)
  LEFT JOIN (SELECT pedal_id, max(begin_ms) AS b FROM pedals p JOIN fh f USING (perf_id) WHERE p.onset * 1000 >= begin_ms GROUP BY 1) fa ON fa.pedal_id = p.pedal_id
  LEFT JOIN (SELECT pedal_id, max(begin_ms) AS b FROM pedals p JOIN fh f USING (perf_id) WHERE (p.onset + p.midi_duration) * 1000 >= begin_ms GROUP BY 1) fb2 ON fb2.pedal_id = p.pedal_id GROUP BY 1)"""
)
def pedal_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    p = ticks.pedal_ticks(derived.pedals(spark, sf_dir), n, _tempos(spark, sf_dir, n))
    return p.select("pedal_id", fixed(F.col("tick_date"), 3).alias("tick_date_u"), fixed(F.col("tick_duration"), 3).alias("tick_duration_u"))


@query(_SPREAD + f"SELECT perf_id, date, {fx('(first - mean) * 720', 2)} AS start_u, {fx('(last - first) * 720', 2)} AS length_u FROM sp JOIN (SELECT perf_id, max(date + duration) AS e FROM notes GROUP BY 1) USING (perf_id) WHERE date / 720.0 + first - mean >= 0 AND date / 720.0 + last - mean < e / 720.0")
def ornament_ms_to_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    o, _ = ornaments.temporal_spread(n)
    t = ticks.ornament_ticks(o, n, derived.constant_tempo(spark, sf_dir)).where("frame_start IS NOT NULL AND frame_length IS NOT NULL")
    return t.select("perf_id", "date", fixed(F.col("frame_start"), 2).alias("start_u"), fixed(F.col("frame_length"), 2).alias("length_u"))


#: One transition for each note: from 60 + pitch to 60 + velocity over 2880 ticks, halfway at 0.2 to 0.8.
_CURVES = ", cv AS (SELECT note_id, 60.0::DOUBLE + midi_pitch AS bpm, 60.0::DOUBLE + velocity AS t2, 0.2::DOUBLE + (note_id % 7) * 0.1::DOUBLE AS im, (note_id % 2880)::DOUBLE AS d FROM notes)"


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    return n.select("note_id", (60.0 + F.col("midi_pitch")).alias("bpm"), (60.0 + F.col("velocity")).alias("t2"), (0.2 + (F.col("note_id") % 7) * 0.1).alias("im"), (F.col("note_id") % 2880).cast("double").alias("d"), F.lit(0.0).alias("zero"), F.lit(2880.0).alias("end"), F.lit(0.25).alias("beat"))


@query(_CURVES + f"SELECT note_id, {fx('bpm + (t2 - bpm) * pow(d / 2880, ln(0.5) / ln(im))', 4)} AS bpm_u FROM cv")
def tempo_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir)
    return c.select("note_id", fixed(kernels.tempo_at(*[F.col(x) for x in ("d", "zero", "end", "bpm", "t2", "im")]), 4).alias("bpm_u"))


@query(
    _CURVES
    + f""", sm AS (SELECT *, CASE WHEN d < 180 THEN 2 ELSE 2 * floor(d / 180) END AS n, ln(0.5) / ln(im) AS p FROM cv)
SELECT note_id, {fx('CASE WHEN d = 0 THEN 0 ELSE d * 5000 / (n * 0.25 * 720) * (1 / bpm + 1 / (bpm + (t2 - bpm) * pow(d / 2880, p)) + coalesce(list_sum(list_transform(range(1, (n / 2)::BIGINT), lambda k: 2 / (bpm + (t2 - bpm) * pow(2 * k * d / n / 2880, p)))), 0) + list_sum(list_transform(range(1, (n / 2)::BIGINT + 1), lambda k: 4 / (bpm + (t2 - bpm) * pow((2 * k - 1) * d / n / 2880, p))))) END', 3)} AS ms_u FROM sm"""
)
def ms_at_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir)
    return c.select("note_id", fixed(kernels.ms_at(*[F.col(x) for x in ("d", "zero", "end", "bpm", "beat", "t2", "im")]), 3).alias("ms_u"))


@query("SELECT note_id, CASE WHEN d <= 0 THEN 0 ELSE d END::BIGINT AS back FROM (SELECT note_id, note_id % 2880 AS d FROM notes)")
def date_at_inverts_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates found again from the time at which a tempo reaches them."""
    c = _curves(spark, sf_dir)
    args = [F.col(x) for x in ("zero", "end", "bpm", "beat", "t2", "im")]
    return kernels.with_dates(c, "back", kernels.ms_at(F.col("d"), *args), *args).select("note_id", F.col("back").cast("long").alias("back"))


_EL = "CASE WHEN abs(a - b) < 0.01 THEN {n} * 60000.0::DOUBLE / a ELSE list_sum(list_transform(range(0, 200), lambda i: 0.5 * (60000.0::DOUBLE / (a + (b - a) * pow(i / 200.0::DOUBLE, ln(0.5) / ln({im}))) + 60000.0::DOUBLE / (a + (b - a) * pow((i + 1) / 200.0::DOUBLE, ln(0.5) / ln({im})))))) * {n} / 200 END"


@query(_CURVES + f", e AS (SELECT note_id, bpm AS a, t2 AS b, im FROM cv) SELECT note_id, {fx(_EL.format(n=4, im='im'), 3)} AS ms_u FROM e")
def elapsed_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir)
    return c.select("note_id", fixed(kernels.elapsed_ms(F.col("bpm"), F.col("t2"), F.col("im"), F.lit(4.0)), 3).alias("ms_u"))


_MET = "target BETWEEN least(m02, m98) AND greatest(m02, m98)"
_OPTIMIZED = (
    _CURVES
    + f""", e AS (SELECT note_id, bpm AS a, t2 AS b, im, 2000.0::DOUBLE + (note_id % 11) * 100 AS target FROM cv),
f AS (SELECT *, {_EL.format(n=4, im='0.02')} AS m02, {_EL.format(n=4, im='0.98')} AS m98, {_EL.format(n=4, im='im')} AS cur FROM e),
bi AS (SELECT note_id, a, b, target, m98 > m02 AS rising, 0.02::DOUBLE AS lo, 0.98::DOUBLE AS hi, 0 AS k FROM f WHERE abs(a - b) >= 0.5 AND {_MET} UNION ALL
  SELECT note_id, a, b, target, rising, CASE WHEN (ms < target) = rising THEN mid ELSE lo END, CASE WHEN (ms < target) = rising THEN hi ELSE mid END, k + 1
  FROM (SELECT *, {_EL.format(n=4, im='mid')} AS ms FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE k < 50)) WHERE abs(ms - target) >= 0.1),
bs AS (SELECT note_id, arg_max((lo + hi) / 2, k) AS shape FROM bi GROUP BY 1)
SELECT note_id, CASE WHEN abs(a - b) < 0.5 THEN abs(240000.0 / target - (a + b) / 2) > 0.5 ELSE NOT {_MET} END AS bpm_scaled,
  {fx(f'CASE WHEN abs(a - b) < 0.5 THEN 240000.0::DOUBLE / target WHEN {_MET} THEN a ELSE a * cur / target END', 3)} AS start_u,
  {fx(f'CASE WHEN abs(a - b) < 0.5 THEN 240000.0::DOUBLE / target WHEN {_MET} THEN b ELSE b * cur / target END', 3)} AS end_u,
  {fx('CASE WHEN abs(a - b) < 0.5 THEN 0.5 ELSE coalesce(shape, im) END', 4)} AS mean_u FROM f LEFT JOIN bs USING (note_id)"""
)


@query(_OPTIMIZED)
def optimize_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _optimized(_curves(spark, sf_dir))


@query(_OPTIMIZED)
def optimize_elapsed_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _optimized(_curves(spark, sf_dir))


def _optimized(curves: DataFrame) -> DataFrame:
    c = curves.withColumn("target", 2000.0 + (F.col("note_id") % 11) * 100)
    o = c.select("note_id", kernels.optimized_elapsed(F.col("bpm"), F.col("t2"), F.col("im"), F.lit(4.0), F.col("target")).alias("o"))
    return o.select("note_id", "o.bpm_scaled", fixed(F.col("o.start_bpm"), 3).alias("start_u"), fixed(F.col("o.end_bpm"), 3).alias("end_u"), fixed(F.col("o.mean_tempo_at"), 4).alias("mean_u"))


_POINTS = """, heads AS (SELECT perf_id, date, first_onset AS onset FROM chords),
st AS (SELECT perf_id, onset AS s, 60000.0::DOUBLE * (date - lag(date) OVER w) / ((onset - lag(onset) OVER w) * 1000 * 720) AS bpm, (date - lag(date) OVER w) AS dt, onset - lag(onset) OVER w AS ds FROM heads WINDOW w AS (PARTITION BY perf_id ORDER BY date)),
tr AS (SELECT perf_id, s, bpm, first_value(s) OVER w AS s0, last_value(s) OVER w AS s1, first_value(bpm) OVER w AS b0, last_value(bpm) OVER w AS b1, count(*) OVER w AS n FROM st WHERE ds > 0 AND dt > 0 WINDOW w AS (PARTITION BY perf_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
gr AS (SELECT perf_id, i, sum((b0 + (b1 - b0) * pow((s - s0) / (s1 - s0), ln(0.5) / ln(i / 100.0::DOUBLE)) - bpm) ** 2) AS err FROM tr, unnest(range(2, 99)) AS u(i) WHERE n >= 2 AND abs(s1 - s0) > 1e-9 AND abs(b1 - b0) > 1e-9 AND (s - s0) / (s1 - s0) > 0.01 AND (s - s0) / (s1 - s0) < 0.99 GROUP BY ALL)
"""


@query(_POINTS + "SELECT perf_id, arg_min(i, (err, i)) AS mean_percent FROM gr GROUP BY perf_id")
def fit_mean_tempo_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.mean_tempo_grid(tempo.trail(tempo.onset_pairs(derived.notes(spark, sf_dir)))).select("perf_id", "mean_percent")


@query(ORACLES["fit_mean_tempo_at"])
def fit_mean_tempo_at_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_mean_tempo_at(spark, sf_dir)


@query(f"""SELECT perf_id, {fx('60000.0::DOUBLE * (d1 - d0) / ((o1 - o0) * 1000 * 720)', 4)} AS bpm_u FROM (SELECT perf_id, min(date) AS d0, max(date) AS d1, arg_min(first_onset, date) AS o0, arg_max(first_onset, date) AS o1 FROM chords GROUP BY perf_id HAVING count(*) > 1)""")
def tempo_constant_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.mean_tempo(derived.notes(spark, sf_dir)).select("perf_id", fixed(F.col("bpm"), 4).alias("bpm_u"))


@query()
def tempo_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tempo.onset_pairs(derived.notes(spark, sf_dir))
    return tempo.fit_tempo(p, [0, 10800, 21600, 36000, 43200])


# ---------------------------------------------------------------- rubato

_RUB = "{d} + (pow((({d} - s) % l) / l, i) * (ee - ls) + ls) * l - (({d} - s) % l)"


@query(", rb AS (SELECT note_id, date::DOUBLE AS d, 0.0::DOUBLE AS s, 2880.0::DOUBLE AS l, 0.5::DOUBLE + (note_id % 10) * 0.1::DOUBLE AS i, least(0.9::DOUBLE, (note_id % 3) * 0.1::DOUBLE) AS ls, 1.0::DOUBLE - (note_id % 4) * 0.05::DOUBLE AS ee FROM notes) " + f"SELECT note_id, {fx(_RUB.format(d='d'), 3)} AS date_u FROM rb")
def rubato_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    at = kernels.rubato_on_date(F.col("date").cast("double"), F.lit(0.0), F.lit(2880.0), 0.5 + (F.col("note_id") % 10) * 0.1, (F.col("note_id") % 3) * 0.1, 1.0 - (F.col("note_id") % 4) * 0.05)
    return n.select("note_id", fixed(at, 3).alias("date_u"))


@query(f", rb AS (SELECT note_id, (note_id % 2880)::DOUBLE AS d, 0.5::DOUBLE + (note_id % 10) * 0.1::DOUBLE AS i FROM notes WHERE note_id % 2880 > 0) SELECT note_id, {fx('2880 * pow(d / 2880, 1 / i)', 2)} AS date_u FROM rb")
def rubato_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir).where("note_id % 2880 > 0")
    none = F.lit(None).cast("double")
    at = kernels.rubato_removed((F.col("note_id") % 2880).cast("double"), F.lit(0.0), F.lit(2880.0), 0.5 + (F.col("note_id") % 10) * 0.1, none, none, 50)
    return n.select("note_id", fixed(at, 2).alias("date_u"))


def _simple_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    return n.withColumn("tick_date", F.col("onset") * 720).withColumn("tick_duration", F.col("midi_duration") * 720)


@query(f"""SELECT perf_id, {fx('CASE WHEN late = 0 THEN NULL ELSE late END', 4)} AS late_u, n FROM (SELECT perf_id, count(*) AS n, least(0.9::DOUBLE, greatest(0.0::DOUBLE, (coalesce(max(t) FILTER (WHERE date = 7200), 7200.0::DOUBLE) - 7200) / 2880)) AS late FROM (
  SELECT perf_id, date, avg(onset * 720) AS t FROM notes WHERE date >= 7200 AND date < 10080 GROUP BY ALL) GROUP BY perf_id)""")
def rubato_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _simple_ticks(spark, sf_dir)
    r = rubato.insert_rubato(n, 7200, 2880)
    counts = n.where("date >= 7200 AND date < 10080").groupBy("perf_id").agg(F.countDistinct("date").alias("n"))
    return r.join(counts, "perf_id").select("perf_id", fixed(F.col("late_start"), 4).alias("late_u"), "n")


_BENT = "list_sum(list_transform(range(1, len(o) + 1), lambda i: (o[i] - ((i - 1) / (len(o) - 1)::DOUBLE) ** {p}) ** 2))"


@query(f""", fc AS (SELECT perf_id, date, avg(onset * 720) AS t FROM notes WHERE date >= 7200 AND date < 10080 GROUP BY ALL),
fs AS (SELECT perf_id, coalesce(max(t) FILTER (WHERE date = 7200), 7200.0::DOUBLE) AS s FROM fc GROUP BY 1),
fd AS (SELECT perf_id, s, list((t - s) / (10080 - s) ORDER BY date) AS d FROM fc JOIN fs USING (perf_id) GROUP BY ALL),
fo AS (SELECT perf_id, least(0.9::DOUBLE, greatest(0.0::DOUBLE, (s - 7200) / 2880)) AS late, CASE WHEN list_contains(d, 0.0::DOUBLE) THEN d ELSE list_prepend(0.0::DOUBLE, d) END AS o FROM fd),
g AS (SELECT perf_id, late, CASE WHEN list_contains(o, 1.0::DOUBLE) THEN o ELSE list_append(o, 1.0::DOUBLE) END AS o, 0.1::DOUBLE AS lo, 5.0::DOUBLE AS hi, 0 AS k FROM fo UNION ALL
  SELECT perf_id, late, o, CASE WHEN {_BENT.format(p='c')} < {_BENT.format(p='d')} THEN lo ELSE c END, CASE WHEN {_BENT.format(p='c')} < {_BENT.format(p='d')} THEN d ELSE hi END, k + 1
  FROM (SELECT *, hi - (hi - lo) / {_GOLD}::DOUBLE AS c, lo + (hi - lo) / {_GOLD}::DOUBLE AS d FROM g WHERE k < 33)),
r AS (SELECT perf_id, late, CASE WHEN len(o) <= 2 THEN 1.0::DOUBLE ELSE (lo + hi) / 2 END AS i FROM g WHERE k = 33),
a AS (SELECT note_id, date, onset * 720 AS td, midi_duration * 720 AS tl, late, i, CASE WHEN r.perf_id IS NOT NULL AND date >= 7200 AND date < 10080 THEN (pow((date - 7200) / 2880.0::DOUBLE, i) * (1 - late) + late) * 2880 - (date - 7200) END AS shift FROM notes LEFT JOIN r USING (perf_id)),
b AS (SELECT *, date + tl - shift AS e FROM a)
SELECT note_id, {fx('td - coalesce(shift, 0)', 1)} AS tick_date_u, {fx('CASE WHEN shift IS NULL THEN tl WHEN e >= 7200 AND e < 10080 THEN tl - shift - (e - 7200) + 7200 + 2880 * pow(greatest(0.0::DOUBLE, ((e - 7200) / 2880 - late) / (1 - late)), 1 / i) ELSE tl - shift END', 1)} AS tick_duration_u FROM b""")
def rubato_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _simple_ticks(spark, sf_dir)
    out = rubato.removed(n, rubato.insert_rubato(n, 7200, 2880))
    return out.select("note_id", fixed(F.col("tick_date"), 1).alias("tick_date_u"), fixed(F.col("tick_duration"), 1).alias("tick_duration_u"))


def _rubatos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relops.chords(derived.notes(spark, sf_dir))
    none = F.lit(None).cast("double")
    return c.select("perf_id", F.col("date").cast("double").alias("date"), F.lit(720.0).alias("frame_length"), (0.7 + (F.col("n_notes") % 4) * 0.15).alias("intensity"), none.alias("late_start"), none.alias("early_end"))


@query(f""", rb AS (SELECT perf_id, date, 0.7::DOUBLE + (n_notes % 4) * 0.15::DOUBLE AS i, row_number() OVER (PARTITION BY perf_id ORDER BY date) AS k, max(date) OVER (PARTITION BY perf_id) AS last FROM chords),
run AS (SELECT perf_id, k, date, last, date AS first, i AS mean, 1 AS n FROM rb WHERE k = 1 UNION ALL
  SELECT perf_id, k, date, last, CASE WHEN go THEN first ELSE date END, CASE WHEN go THEN (mean * n + i) / (n + 1) ELSE i END, CASE WHEN go THEN n + 1 ELSE 1 END FROM (
    SELECT b.perf_id, b.k, b.date, b.last, b.i, r.first, r.mean, r.n, b.date = r.date + 720 AND b.date < b.last AND (r.mean < 1) = (b.i < 1) AND r.mean <> 1 AND b.i <> 1 AND abs(b.i - r.mean) < 0.2 AS go
    FROM run r JOIN rb b ON b.perf_id = r.perf_id AND b.k = r.k + 1)),
whole AS (SELECT perf_id, first, max(n) AS n, arg_max(mean, k) AS mean, max(date) + 720 AS after, max(last) AS last FROM run GROUP BY ALL)
SELECT perf_id, first AS date, {fx('mean')} AS intensity_u, CASE WHEN n > 1 THEN 0.0::DOUBLE END AS late_start, CASE WHEN n > 1 THEN 1.0::DOUBLE END AS early_end, n > 1 AS loop FROM whole
UNION ALL SELECT perf_id, after, NULL, NULL, NULL, false FROM whole w WHERE n > 1 AND after < last AND NOT EXISTS (SELECT 1 FROM rb WHERE rb.perf_id = w.perf_id AND rb.date = w.after)""")
def rubato_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = ops.extent(derived.notes(spark, sf_dir))
    out = rubato.combined(_rubatos(spark, sf_dir), last)
    return out.select("perf_id", F.col("date").cast("long").alias("date"), fixed(F.col("intensity")).alias("intensity_u"), "late_start", "early_end", "loop")


# ---------------------------------------------------------------- dynamics

_DYN = ", pt AS (SELECT perf_id, date, mean_velocity AS v FROM chords WHERE date BETWEEN 3600 AND 18000)"


@query(_DYN + f" SELECT perf_id, min(date) AS date, {fx('arg_min(v, date)')} AS volume_u, CASE WHEN count(*) > 1 THEN {fx('arg_max(v, date)')} END AS to_u FROM pt GROUP BY perf_id")
def dynamics_two_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dynamics.two_point(dynamics.points(derived.notes(spark, sf_dir), start=3600, end=18000))
    return d.select("perf_id", F.col("date").cast("long").alias("date"), fixed(F.col("volume")).alias("volume_u"), fixed(F.col("transition_to")).alias("to_u"))


def _grid_round(r: int) -> str:
    """One round of the search: 13 curvatures and protractions about the best so far, and the pair of least error."""
    steps = ", ".join(f"{0.5**k!r}::DOUBLE" for k in range(1, 25))
    place = f"list_reduce([{steps}], lambda low, h: CASE WHEN ((3 * x1 - 3 * x2 + 1) * (low + h) + (3 * x2 - 6 * x1)) * (low + h) * (low + h) + 3 * x1 * (low + h) < x THEN low + h ELSE low END, 0.0::DOUBLE)"
    axis = lambda b, reach, k: f"CASE WHEN {k} = 12 THEN {b} + {reach} ELSE {b} - {reach} + {k} * (({b} + {reach}) - ({b} - {reach})) / 12 END"
    return f""",
g{r} AS (SELECT perf_id, rc, rp, ic, ip, least(1.0::DOUBLE, greatest(0.0::DOUBLE, {axis('bc', 'rc', 'ic')})) AS c, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {axis('bp', 'rp', 'ip')})) AS p FROM q{r - 1}, unnest(range(13)) AS a(ic), unnest(range(13)) AS b(ip)),
h{r} AS (SELECT *, CASE WHEN p > 0 THEN c + (1 - c) * p ELSE c + c * p END AS x1, CASE WHEN p > 0 THEN 1 - c + c * p ELSE 1 - c + (1 - c) * p END AS x2 FROM g{r}),
t{r} AS (SELECT h.perf_id, rc, rp, ic, ip, c, p, v, v0, v1, {place} + {0.5**25!r}::DOUBLE AS t FROM h{r} h JOIN px USING (perf_id)),
q{r} AS (SELECT perf_id, arg_min(c, (err, ip, ic)) AS bc, arg_min(p, (err, ip, ic)) AS bp, any_value(rc) / 5 AS rc, any_value(rp) / 5 AS rp FROM (
  SELECT perf_id, rc, rp, ic, ip, c, p, sum(abs((3 - 2 * t) * t * t * (v1 - v0) + v0 - v)) AS err FROM t{r} GROUP BY ALL) GROUP BY perf_id)"""


@query(_DYN + """, pa AS (SELECT perf_id, count(*) AS n, min(date) AS d0, max(date) AS d1, arg_min(v, date) AS v0, arg_max(v, date) AS v1 FROM pt GROUP BY 1),
px AS (SELECT perf_id, v, v0, v1, (date - d0) / (d1 - d0)::DOUBLE AS x FROM pt JOIN pa USING (perf_id) WHERE n > 2 AND v0 <> v1),
q0 AS (SELECT DISTINCT perf_id, 0.5::DOUBLE AS bc, 0.0::DOUBLE AS bp, 0.5::DOUBLE AS rc, 1.0::DOUBLE AS rp FROM px)""" + "".join(map(_grid_round, range(1, 5)))
    + f" SELECT perf_id, d0 AS date, {fx('v0')} AS volume_u, CASE WHEN n > 1 THEN {fx('v1')} END AS to_u, CASE WHEN n > 1 THEN {fx('coalesce(bc, 0.5::DOUBLE)', 4)} END AS curvature_u, CASE WHEN n > 1 THEN {fx('coalesce(bp, 0.0::DOUBLE)', 4)} END AS protraction_u FROM pa LEFT JOIN q4 USING (perf_id)")
def dynamics_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dynamics.fit_dynamics(dynamics.points(derived.notes(spark, sf_dir), start=3600, end=18000))
    values = (("volume", "volume_u", 6), ("transition_to", "to_u", 6), ("curvature", "curvature_u", 4), ("protraction", "protraction_u", 4))
    return d.select("perf_id", F.col("date").cast("long").alias("date"), *[fixed(F.col(c), k).alias(out) for c, out, k in values])


#: Written as the kernel adds it up, since places a tick off are told from those that are less.
_ALONG = "(2880 * ({t} * (3 * c + {t} * (3 * (1 - c) - 6 * c + {t} * (3 * c - 3 * (1 - c) + 1)))))"
_HALVES = ", ".join(f"{0.5**k!r}::DOUBLE" for k in range(1, 49))


@query(f""", b AS (SELECT note_id, 1 + note_id % 2879 AS d, (note_id % 11) / 10.0::DOUBLE AS c, velocity AS v0, 60.0::DOUBLE + midi_pitch AS v1 FROM notes),
root AS (SELECT *, list_reduce([{_HALVES}], lambda low, h: CASE WHEN {_ALONG.format(t='(low + h)')} <= d THEN low + h ELSE low END, 0.0::DOUBLE) AS root FROM b),
cell AS (SELECT *, list_transform(range(0, 32), lambda k: (floor(root * 2 ** k) + 0.5) / 2 ** k) AS centres FROM root),
met AS (SELECT *, coalesce(list_filter(centres, lambda m: abs({_ALONG.format(t='m')} - d) < 1)[1], root) AS t FROM cell)
SELECT note_id, {fx('CASE WHEN v0 = v1 THEN v0 ELSE v0 + (v1 - v0) * t * t * (3 - 2 * t) END', 3)} AS volume_u FROM met""")
def volume_at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    v = kernels.eased((1 + F.col("note_id") % 2879).cast("double"), F.lit(0.0), F.lit(2880.0), F.col("velocity"), 60.0 + F.col("midi_pitch"), (F.col("note_id") % 11) / 10.0, F.lit(0.0))
    return n.select("note_id", fixed(v, 3).alias("volume_u"))


@query(", p AS (SELECT note_id, date, velocity AS v0 FROM notes) " + f"SELECT n.note_id, {fx('n.velocity - first_value(n.velocity) OVER (PARTITION BY n.perf_id, n.date // 7200 ORDER BY n.seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS change_u FROM notes n JOIN (SELECT perf_id, max(date + duration) AS e FROM notes GROUP BY 1) USING (perf_id) WHERE n.date < e")
def residual_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    none = F.lit(None).cast("double")
    d = n.groupBy("perf_id", F.floor(F.col("date") / 7200).alias("k")).agg(F.min_by("velocity", "seq").alias("volume")).select("perf_id", (F.col("k") * 7200.0).alias("date"), "volume", none.alias("transition_to"), none.alias("curvature"), none.alias("protraction"))
    return dynamics.residual(n, d).select("note_id", fixed(F.col("abs_vel_change")).alias("change_u"))


# ---------------------------------------------------------------- accentuation

_ACC = """, an AS (SELECT perf_id, note_id, date, midi_pitch - 60.0::DOUBLE AS ch FROM notes WHERE date >= 7200),
ad AS (SELECT perf_id, date, avg(ch) AS m, (date - 7200) // 2880 AS c0 FROM an GROUP BY ALL),
ab AS (SELECT perf_id, c0 AS cell, (date - 7200 - c0 * 2880) / 720.0::DOUBLE + 1 AS beat, m FROM ad WHERE (date - 7200) % 720 = 0
  UNION ALL SELECT perf_id, c0 - 1, 5.0::DOUBLE, m FROM ad WHERE (date - 7200) % 2880 = 0 AND c0 > 0),
az AS (SELECT *, max(abs(m)) OVER (PARTITION BY perf_id, cell) AS scale FROM ab),
ap AS (SELECT perf_id, cell, beat, m / scale AS value, lead(m / scale) OVER (PARTITION BY perf_id, cell ORDER BY beat) AS t FROM az WHERE scale <> 0)
"""


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.notes(spark, sf_dir).withColumn("abs_vel_change", F.col("midi_pitch") - 60.0)


@query(_ACC + f"SELECT perf_id, cell, {fx('beat')} AS beat_u, {fx('m')} AS velocity_u FROM ab")
def accent_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = accentuation.beat_velocities(_changed(spark, sf_dir), derived.meta(spark, sf_dir), 7200, 10080)
    return v.select("perf_id", "cell", fixed(F.col("beat")).alias("beat_u"), fixed(F.col("velocity")).alias("velocity_u"))


@query(_ACC + f"SELECT perf_id, cell, {fx('beat')} AS beat_u, {fx('value')} AS value_u, {fx('t')} AS to_u FROM ap WHERE t IS NOT NULL")
def accent_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = accentuation.beat_velocities(_changed(spark, sf_dir), derived.meta(spark, sf_dir), 7200, 10080)
    p = accentuation.patterns(v)
    return p.select("perf_id", "cell", fixed(F.col("beat")).alias("beat_u"), fixed(F.col("value")).alias("value_u"), fixed(F.col("transition_to")).alias("to_u"))


_LOOP = _ACC.rstrip() + """,
l0 AS (SELECT perf_id, beat, floor(value + 0.5) AS r FROM ap WHERE t IS NOT NULL AND cell = 0),
lf AS (SELECT perf_id, list({'beat': beat, 'value': value, 'to': t} ORDER BY beat) AS ch FROM ap WHERE t IS NOT NULL AND cell = 0 GROUP BY 1),
ls AS (SELECT perf_id, cell, max(abs(m)) AS scale FROM ab GROUP BY ALL),
lc AS (SELECT perf_id, cell, scale, coalesce(same, true) AS same FROM ls LEFT JOIN (SELECT perf_id, cell, bool_and(coalesce(floor(value + 0.5) = r, true)) AS same FROM ap LEFT JOIN l0 USING (perf_id, beat) WHERE t IS NOT NULL GROUP BY ALL) USING (perf_id, cell)),
lt AS (SELECT perf_id, greatest(ceil((max(date + duration) - 10080) / 2880.0::DOUBLE), 0) AS tried FROM notes GROUP BY 1),
lp AS (SELECT perf_id, scale, 0 AS n, 0 AS k, true AS going, tried FROM lf JOIN ls USING (perf_id) JOIN lt USING (perf_id) WHERE cell = 0 UNION ALL
  SELECT perf_id, CASE WHEN ok THEN (scale * n + own) / (n + 1) ELSE scale END, n + ok::INT, k + 1, ok, tried FROM (
    SELECT p.*, c.scale AS own, coalesce(c.scale <> 0 AND c.same AND abs(c.scale - p.scale) <= 10, false) AS ok FROM lp p LEFT JOIN lc c ON c.perf_id = p.perf_id AND c.cell = p.k + 1 WHERE p.going AND p.k < p.tried)),
lo AS (SELECT perf_id, arg_max(scale, k) AS scale, arg_max(n, k) AS n, max(k) AS last FROM lp GROUP BY 1),
lr AS (SELECT perf_id, scale, n, 7200 + last * 2880 > 10080 AS loop, CASE WHEN 7200 + last * 2880 > 10080 THEN 7200 + last * 2880 END AS neutral_date FROM lo)
"""


@query(_LOOP + f"SELECT perf_id, {fx('scale')} AS scale_u, n AS repeats, loop, neutral_date FROM lr")
def accent_loop_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = accentuation.looped(_changed(spark, sf_dir), derived.meta(spark, sf_dir), 7200, 10080, scale_tolerance=10.0)
    return found.select("perf_id", fixed(F.col("scale")).alias("scale_u"), "repeats", "loop", "neutral_date")


@query(_LOOP + f""", rn AS (SELECT note_id, midi_pitch - 60.0::DOUBLE AS ch0, ch, scale, 1 + ((date - 7200) % 2880) / 720.0::DOUBLE AS beat,
  coalesce(date >= 7200 AND (loop OR date < 10080) AND (neutral_date IS NULL OR date < neutral_date), false) AS inside FROM notes LEFT JOIN lr USING (perf_id) LEFT JOIN lf USING (perf_id)),
rx AS (SELECT *, list_filter(ch, lambda a: a.beat = beat) AS exact, list_filter(ch, lambda a: a.beat < beat) AS below, list_filter(ch, lambda a: a.beat > beat) AS above FROM rn WHERE inside AND ch[1].beat <= beat),
ra AS (SELECT note_id, scale * CASE WHEN len(exact) > 0 THEN exact[1].value ELSE below[-1].value + (beat - below[-1].beat) * (below[-1]['to'] - below[-1].value) / (CASE WHEN len(above) > 0 THEN above[1].beat ELSE 5 END - below[-1].beat) END AS accent FROM rx)
SELECT note_id, {fx('ch0 - coalesce(accent, 0)')} AS change_u FROM rn LEFT JOIN ra USING (note_id)""")
def accent_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = _changed(spark, sf_dir), derived.meta(spark, sf_dir)
    found = accentuation.looped(n, m, 7200, 10080, scale_tolerance=10.0)
    return accentuation.accent_residual(n, found, m, 7200, 10080).select("note_id", fixed(F.col("abs_vel_change")).alias("change_u"))


@query(_ACC + f"SELECT perf_id, {fx('beat')} AS beat_u, {fx('CASE WHEN v2 IS NULL THEN v1 ELSE (v1 + v2) / 2 END')} AS value_u FROM (SELECT a.perf_id, a.beat, a.value AS v1, b.value AS v2 FROM (SELECT * FROM ap WHERE t IS NOT NULL AND cell = 0) a LEFT JOIN (SELECT * FROM ap WHERE t IS NOT NULL AND cell = 1) b ON a.perf_id = b.perf_id AND a.beat = b.beat WHERE a.perf_id IN (SELECT perf_id FROM ap WHERE t IS NOT NULL AND cell = 1))")
def accent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = accentuation.beat_velocities(_changed(spark, sf_dir), derived.meta(spark, sf_dir), 7200, 10080)
    p = accentuation.patterns(v).where("cell < 3").select("perf_id", F.col("cell").alias("pos"), F.concat(F.lit("cell_"), F.col("cell")).alias("name"), "beat", "value", "transition_from", "transition_to")
    return accentuation.merged(p, ["cell_0", "cell_1"], "both").select("perf_id", fixed(F.col("beat")).alias("beat_u"), fixed(F.col("value")).alias("value_u"))


# ---------------------------------------------------------------- articulation

_ART = ", ar AS (SELECT *, midi_duration * 720 AS td FROM notes)"


def _articulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simple_ticks(spark, sf_dir).withColumn("abs_vel_change", F.when(F.col("note_id") % 2 == 0, 3.0))


@query(_ART + f" SELECT note_id, {fx('td / duration')} AS rel_dur_u, {fx('(CASE WHEN note_id % 2 = 0 THEN 3.0 ELSE 0.0 END + velocity) / velocity')} AS rel_vel_u, {fx('td')} AS abs_dur_u, {fx('td - duration')} AS change_u FROM ar")
def articulation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = articulation.values(_articulated(spark, sf_dir))
    return v.select("note_id", *[fixed(F.col(a)).alias(b) for a, b in (("rel_dur", "rel_dur_u"), ("rel_vel", "rel_vel_u"), ("abs_dur", "abs_dur_u"), ("abs_dur_change", "change_u"))])


@query(_ART + f" SELECT perf_id, {fx('avg(td / duration)')} AS rel_dur_u FROM ar WHERE midi_pitch > 70 GROUP BY perf_id")
def articulation_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = articulation.values(_articulated(spark, sf_dir).where("midi_pitch > 70"))
    return articulation.definition(v, ("rel_dur",)).select("perf_id", fixed(F.col("rel_dur")).alias("rel_dur_u"))


@query(_ART + f" SELECT note_id, {fx('CASE WHEN midi_pitch > 70 THEN td / m ELSE td END', 4)} AS tick_duration_u FROM ar LEFT JOIN (SELECT perf_id, avg(td / duration) AS m FROM ar WHERE midi_pitch > 70 GROUP BY 1) USING (perf_id)")
def articulation_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _articulated(spark, sf_dir)
    chosen = articulation.values(n.where("midi_pitch > 70"))
    return articulation.undone(n, chosen, articulation.definition(chosen, ("rel_dur",))).select("note_id", fixed(F.col("tick_duration"), 4).alias("tick_duration_u"))


@query("SELECT perf_id, date, string_agg('#' || note_id, ' ' ORDER BY seq) AS noteid FROM notes WHERE midi_pitch > 70 GROUP BY ALL")
def articulation_merge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = articulation.instructions(articulation.values(_articulated(spark, sf_dir).where("midi_pitch > 70")), "short")
    return i.select("perf_id", "date", F.array_join("noteid", " ").alias("noteid"))


@query(_ART + f" SELECT perf_id, {fx('avg(td / duration)')} AS rel_dur_u FROM ar WHERE midi_pitch <= 70 GROUP BY perf_id")
def default_articulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _articulated(spark, sf_dir)
    named = n.where("midi_pitch > 70").groupBy("perf_id", "date").agg(F.collect_list("note_id").alias("noteid"))
    mean, _ = ops.make_default_articulation(n, named)
    return mean.select("perf_id", fixed(F.col("rel_dur")).alias("rel_dur_u"))


# ---------------------------------------------------------------- clustering

_REACH = """, idx AS (SELECT perf_id, row_number() OVER (PARTITION BY perf_id ORDER BY seq) AS i, {dims} FROM {src}),
nb AS (SELECT a.perf_id, a.i AS a, b.i AS b FROM idx a JOIN idx b ON a.perf_id = b.perf_id AND a.i <> b.i AND {near}),
rc AS (SELECT perf_id, i AS a, i AS root FROM idx UNION SELECT n.perf_id, n.b, r.root FROM rc r JOIN nb n ON n.perf_id = r.perf_id AND n.a = r.a),
rt AS (SELECT perf_id, a, min(root) AS root FROM rc GROUP BY ALL),
gs AS (SELECT perf_id, root FROM rt GROUP BY ALL HAVING count(*) > 1),
sz AS (SELECT perf_id, root, dense_rank() OVER (PARTITION BY perf_id ORDER BY root) - 1 AS label FROM gs)
SELECT perf_id, a AS index, coalesce(label, -1) AS label FROM rt LEFT JOIN sz USING (perf_id, root)"""


def _indexed(n: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return n.withColumn("index", F.row_number().over(Window.partitionBy("perf_id").orderBy("seq")))


@query(_REACH.format(dims="velocity AS x", src="notes", near="abs(a.x - b.x) <= 0.5"))
def dbscan_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.cluster(_indexed(derived.notes(spark, sf_dir)), {"velocity": 0.5}).select("perf_id", "index", "label")


@query(ORACLES["dbscan_1d"])
def dbscan_1d_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan_1d(spark, sf_dir)


@query(_REACH.format(dims="velocity AS x, onset AS y", src="notes", near="abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 2"))
def dbscan_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _indexed(derived.notes(spark, sf_dir))
    return relops.cluster(n, {"onset": 2.0, "velocity": 4.0}).select("perf_id", "index", "label")


@query(_REACH.format(dims="midi_duration * 720 / duration AS x, velocity AS y", src="notes", near="abs(a.x - b.x) <= 0.05 AND abs(a.y - b.y) <= 2").replace("SELECT perf_id, a AS index, coalesce(label, -1) AS label FROM rt LEFT JOIN sz USING (perf_id, root)", "SELECT perf_id, label, count(*) AS n FROM rt JOIN sz USING (perf_id, root) GROUP BY ALL"))
def stylize_articulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _simple_ticks(spark, sf_dir)
    a = n.select("perf_id", "note_id", "seq", (F.col("tick_duration") / F.col("duration")).alias("rel_dur"), F.col("velocity").alias("rel_vel"))
    _, defs = articulation.stylized(a, n, 2.0, 0.05)
    return defs.select("perf_id", "label", "n")


@query(_ART + ", tt AS (SELECT *, onset * 720 AS tk FROM ar) SELECT a.note_id FROM tt a WHERE EXISTS (SELECT 1 FROM tt b WHERE b.perf_id = a.perf_id AND b.midi_pitch = a.midi_pitch AND a.tk < b.tk AND a.tk + a.duration * 1.5 > b.tk)")
def articulation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _simple_ticks(spark, sf_dir)
    return articulation.conflicts(n, n.select("perf_id", "note_id", "seq", F.lit(1.5).alias("mean"))).select("note_id")


def _closure(name: str, keys: str, near: str) -> str:
    """Labels of points of table name (keys, i): clusters of those that reach each other, from 0 by their first, or -1 alone."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    there = " AND ".join(f"n.{k} = r.{k}" for k in keys.split(", "))
    nk, ak = (", ".join(f"{t}.{k}" for k in keys.split(", ")) for t in "na")
    return f"""
{name}_nb AS (SELECT {ak}, a.i AS a, b.i AS b FROM {name} a JOIN {name} b ON {same} AND a.i <> b.i AND {near}),
{name}_rc AS (SELECT {keys}, i AS a, i AS root FROM {name} UNION SELECT {nk}, n.b, r.root FROM {name}_rc r JOIN {name}_nb n ON {there} AND n.a = r.a),
{name}_rt AS (SELECT {keys}, a, min(root) AS root FROM {name}_rc GROUP BY ALL),
{name}_sz AS (SELECT {keys}, root, dense_rank() OVER (PARTITION BY {keys} ORDER BY root) - 1 AS label FROM {name}_rt GROUP BY {keys}, root HAVING count(*) > 1),
{name}_lb AS (SELECT {keys}, a AS i, coalesce(label, -1) AS label FROM {name}_rt LEFT JOIN {name}_sz USING ({keys}, root))"""


@query(
    _SPREAD + ", " + ORACLES["spread_intensity"].split(_SPREAD)[1].split("SELECT perf_id, date, CAST(floor")[0].lstrip(", ").rstrip()
    + _GRADIENT.format(src="notes").rstrip()
    + """, od AS (SELECT perf_id, date, row_number() OVER (PARTITION BY perf_id ORDER BY date) AS i, (first - mean) * 1000 AS fs, (last - first) * 1000 AS fl, coalesce((lo_ + hi_) / 2, 1.0::DOUBLE) AS st,
  CASE WHEN mono THEN 'monophonic' WHEN same AND doff > (last - first) * 0.8 THEN 'true' ELSE 'false' END AS shift, coalesce(a, 0.0::DOUBLE) AS g0, coalesce(b, 0.0::DOUBLE) AS g1
  FROM sp LEFT JOIN (SELECT perf_id, date, lo AS lo_, hi AS hi_ FROM g WHERE k = 33) USING (perf_id, date) LEFT JOIN gs USING (perf_id, date)),"""
    + _closure("od", "perf_id", "abs(a.fs - b.fs) <= 40 AND abs(a.fl - b.fl) <= 40 AND abs(a.st - b.st) <= 0.3 AND a.shift = b.shift")
    + """,
oi AS (SELECT od.*, label AS outside FROM od JOIN od_lb USING (perf_id, i) WHERE label >= 0),"""
    + _closure("oi", "perf_id, outside", "abs(a.g0 - b.g0) <= 0.1 AND abs(a.g1 - b.g1) <= 0.1")
    + f""",
nm AS (SELECT od.*, CASE WHEN l.label >= 0 THEN 'def_global_' || l.outside || '_' || l.label ELSE 'def_single_' || i END AS name FROM od LEFT JOIN oi_lb l USING (perf_id, i))
SELECT perf_id, name, count(*) AS n, {fx('avg(fs)', 0)} AS start_u, {fx('avg(fl)', 0)} AS length_u, {fx('avg(st)', 3)} AS intensity_u, {fx('avg(g0)')} AS from_u, {fx('avg(g1)')} AS to_u, arg_min(shift, i) AS noteoff_shift FROM nm GROUP BY ALL"""
)
def stylize_ornaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir)
    o, _ = ornaments.temporal_spread(n)
    g, _ = ornaments.dynamics_gradient(n)
    o = o.join(g.select("perf_id", "date", "transition_from", "transition_to", "scale"), ["perf_id", "date"], "left").withColumn("id", F.concat(F.lit("ornament_"), F.col("date")))
    _, defs = ornaments.stylized(o, tick_tolerance=40.0)
    d = ornaments.compressed(defs)
    values = (("intensity", "intensity_u", 3), ("transition_from", "from_u", 6), ("transition_to", "to_u", 6))
    return d.select("perf_id", "name", "n", F.col("frame_start").cast("long").alias("start_u"), F.col("frame_length").cast("long").alias("length_u"), *[fixed(F.col(c), k).alias(out) for c, out, k in values], "noteoff_shift")


# ---------------------------------------------------------------- parts, pedals

_ASY = """, hd AS (SELECT perf_id, date, part, arg_min(onset, seq) AS o FROM notes WHERE date BETWEEN 3600 AND 36000 GROUP BY ALL),
sh AS (SELECT a.perf_id, avg(a.o - b.o) AS s FROM hd a JOIN hd b ON a.perf_id = b.perf_id AND a.date = b.date AND a.part = 2 AND b.part = 1 GROUP BY 1)
"""


@query(_ASY + f"SELECT perf_id, {fx('s * 1000', 3)} AS ms_u FROM sh")
def asynchrony_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift, _ = ops.asynchrony(derived.notes(spark, sf_dir), 1, 3600, 36000)
    return shift.select("perf_id", fixed(F.col("shift") * 1000, 3).alias("ms_u"))


@query(_ASY + f"SELECT note_id, {fx('CASE WHEN part = 2 AND date BETWEEN 3600 AND 36000 THEN onset - coalesce(s, 0) ELSE onset END')} AS onset_u FROM notes LEFT JOIN sh USING (perf_id)")
def asynchrony_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = ops.asynchrony(derived.notes(spark, sf_dir), 1, 3600, 36000)
    return n.select("note_id", fixed(F.col("onset")).alias("onset_u"))


def _movements(direction: str):
    down = direction == "down"
    base = "onset * 720" if down else "(onset + midi_duration) * 720"
    rows = ("_start", 0.0, 0.8, "_moveDown", 0.8) if down else ("_moveUp", 0.8, 0.0, "_end", 0.0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = derived.pedals(spark, sf_dir).withColumn("tick_date", F.col("onset") * 720).withColumn("tick_duration", F.col("midi_duration") * 720)
        m = ops.pedal_movements(p, -60.0, 120.0, direction, 0.8)
        return m.select("perf_id", "id", fixed(F.col("date"), 3).alias("date_u"), fixed(F.col("position")).alias("position_u"), fixed(F.col("transition_to")).alias("to_u"), "controller")

    run.__name__ = f"pedal_movements_{direction}"
    sql = f"""SELECT perf_id, pedal_id || '{rows[0]}' AS id, {fx(base + ' - 60', 3)} AS date_u, {fx(f'{rows[1]}::DOUBLE')} AS position_u, {fx(f'{rows[2]}::DOUBLE')} AS to_u, type AS controller FROM pedals
  UNION ALL SELECT perf_id, pedal_id || '{rows[3]}', {fx(base + ' + 60', 3)}, {fx(f'{rows[4]}::DOUBLE')}, NULL, type FROM pedals"""
    return query(sql)(run)


_movements("down")
_movements("up")


@query(f"SELECT perf_id, date, {fx('(mean_onset - first_onset) * 1000', 0)} AS start_u FROM chords")
def compress_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relops.chords(derived.notes(spark, sf_dir)).select("perf_id", "date", ((F.col("mean_onset") - F.col("first_onset")) * 1000).alias("frame_start"), F.lit(0.0).alias("frame_length"))
    return ornaments.compressed(c).select("perf_id", "date", F.col("frame_start").cast("long").alias("start_u"))
