"""Tables of ranges and the store of instructions, over the derived performances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.operators import ranges, relops, store
from tactuslab.queries.base import query
from tactuslab.sources import derived

_RANGES = """, rg AS (SELECT perf_id, date AS start, date + 720 * (n_notes % 4) AS "end" FROM chords WHERE date % 1440 = 0),
lv AS (SELECT * FROM rg WHERE start < "end"),
ed AS (SELECT perf_id, start AS spot FROM lv UNION SELECT perf_id, "end" FROM lv),
mg AS (SELECT perf_id, start, "end", coalesce(start > max("end") OVER (PARTITION BY perf_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM lv),
cv AS (SELECT perf_id, min(start) AS start, max("end") AS "end", count(*) AS n_ranges FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY perf_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS part FROM mg) GROUP BY perf_id, part)
"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from every other chord on, none to three beats long."""
    c = relops.chords(derived.notes(spark, sf_dir)).where("date % 1440 = 0")
    return c.select("perf_id", F.col("date").alias("start"), (F.col("date") + 720 * (F.col("n_notes") % 4)).alias("end"))


@query(_RANGES + 'SELECT perf_id, start, "end", n_ranges FROM cv')
def range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.coverage(_ranges(spark, sf_dir)).select("perf_id", "start", "end", "n_ranges")


@query(_RANGES + """SELECT p.perf_id, spot AS start, until AS "end", count(*) AS depth FROM (SELECT perf_id, spot, lead(spot) OVER (PARTITION BY perf_id ORDER BY spot) AS until FROM ed) p
  JOIN lv ON lv.perf_id = p.perf_id AND lv.start <= spot AND spot < lv."end" GROUP BY ALL HAVING count(*) > 1""")
def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.overlaps(_ranges(spark, sf_dir)).select("perf_id", "start", "end", "depth")


@query(_RANGES + 'SELECT perf_id, date, cv.start AS range_start, cv."end" AS range_end FROM chords JOIN cv USING (perf_id) WHERE date BETWEEN cv.start AND cv."end"')
def onsets_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords with the stretch that covers them, its borders included."""
    c = relops.chords(derived.notes(spark, sf_dir)).select("perf_id", "date")
    return ranges.members(c, ranges.coverage(_ranges(spark, sf_dir)))


@query(_RANGES + """, tp AS (SELECT perf_id, date, n_notes AS bpm FROM chords WHERE date % 2160 = 0),
pl AS (SELECT tp.*, cv.start, cv."end" FROM tp LEFT JOIN cv ON tp.perf_id = cv.perf_id AND tp.date >= cv.start AND tp.date < cv."end")
SELECT perf_id, date, bpm, false AS restored FROM pl WHERE start IS NULL
UNION ALL SELECT perf_id, "end", arg_max(bpm, date), true FROM pl p WHERE start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tp WHERE tp.perf_id = p.perf_id AND tp.date = p."end") GROUP BY perf_id, "end\"""")
def tempos_under_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempos outside of all ranges; what was in force where a covered stretch ends begins anew there."""
    t = relops.chords(derived.notes(spark, sf_dir)).where("date % 2160 = 0").select("perf_id", "date", F.col("n_notes").alias("bpm"))
    return ranges.uncovered(t, _ranges(spark, sf_dir))


_STORE = """, hv AS (SELECT perf_id, CASE WHEN part = 1 THEN 0 END AS scope, date, max(seq) AS id FROM notes WHERE date % 1440 = 0 GROUP BY ALL),
nw AS (SELECT perf_id, CASE WHEN part = 1 THEN 0 END AS scope, date, max(seq) FILTER (WHERE midi_pitch % 2 = 0) AS id FROM notes WHERE date % 2160 = 0 AND midi_pitch % 2 = 0 GROUP BY ALL),
pt AS (SELECT coalesce(n.perf_id, h.perf_id) AS perf_id, CASE WHEN n.perf_id IS NULL THEN h.scope ELSE n.scope END AS scope, coalesce(n.date, h.date) AS date, coalesce(n.id, h.id) AS id
  FROM hv h FULL JOIN nw n ON h.perf_id = n.perf_id AND h.scope IS NOT DISTINCT FROM n.scope AND h.date = n.date)
"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of two writers: the last note of each date and scope, and over these the last of an even pitch."""
    n = derived.notes(spark, sf_dir).select("perf_id", F.when(F.col("part") == 1, 0).alias("scope"), "date", F.col("seq").alias("id"), "midi_pitch")
    have = n.where("date % 1440 = 0").groupBy("perf_id", "scope", "date").agg(F.max("id").alias("id"))
    return store.put(have, n.where("date % 2160 = 0 AND midi_pitch % 2 = 0").drop("midi_pitch"), ["id"])


@query(_STORE + "SELECT perf_id, scope, date, id FROM pt")
def store_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)


@query(_STORE + "SELECT perf_id, scope, date, id FROM pt WHERE NOT EXISTS (SELECT 1 FROM notes WHERE notes.perf_id = pt.perf_id AND notes.date = pt.date AND notes.source = 'error' AND pt.scope IS NOT DISTINCT FROM CASE WHEN part = 1 THEN 0 END)")
def store_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = derived.notes(spark, sf_dir).where("source = 'error'").select("perf_id", F.when(F.col("part") == 1, 0).alias("scope"), "date")
    return store.remove(_stored(spark, sf_dir), keys)


@query(_STORE + """, ps AS (SELECT note_id, perf_id, CASE WHEN part = 1 THEN 0 END AS scope, date FROM notes)
SELECT note_id, (SELECT arg_max(pt.id, pt.date) FROM pt WHERE pt.perf_id = ps.perf_id AND pt.scope IS NOT DISTINCT FROM ps.scope AND pt.date <= ps.date) AS id FROM ps""")
def store_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.notes(spark, sf_dir).select("note_id", "perf_id", F.when(F.col("part") == 1, 0).alias("scope"), "date")
    return store.in_force(n, _stored(spark, sf_dir), ["id"]).select("note_id", "id")
