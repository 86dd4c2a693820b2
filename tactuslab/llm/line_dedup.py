"""Line dedup: later copies of repeated line runs, found by a suffix array over line ids.

The corpus is the sequence of its lines that aren't blank, document after document by ascending
doc_id. Prefix doubling ranks all suffixes by their first 1, 2, 4, ... lines: a rank is the place of
a pair of ranks in their sorted order, and only suffixes that share theirs with another go on. A run
of m lines is a prefix of suffixes with one longest-common-prefix interval of depth m; the interval is
named by the ranks, at the largest power of two within m, of the run's head and tail. Of each interval
of runs of MIN_WORDS words or more the first in the corpus stays, and the lines of the others go.
Every line of such a run lies in a shortest run of enough words from its head or up to its tail, so
only these shortest runs are looked up; together they make up the maximal runs. Lines count as equal
if two hashes of 64 and 32 bits are.

A line or run that a third of the corpus repeats is a hot key of three joins, with the lines that occur
twice, with the ranks and with the intervals. Both sides of these are written tables or plain exchanges, and what follows deals
out by another key, so adaptive execution splits such a key over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.llm.common import discard, saved

MIN_WORDS = 50
KEY = ["doc_id", "th"]


def _line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(line, "\t\r\x0b\x0c", "    "), " "), lambda w: w != ""))


def _positions(documents: DataFrame) -> DataFrame:
    """doc_id, th, p, line, h, h2, w: each line that isn't blank, numbered among these and among all."""
    info = F.transform(_line_array(F.col("text")), lambda x, k: F.struct(k.alias("line"), F.xxhash64(x).alias("h"), F.hash(x).alias("h2"), _words(x).alias("w")))
    rows = documents.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.filter(info, lambda x: x.w > 0)).alias("p", "x"))
    return rows.select("doc_id", "th", "p", "x.line", "x.h", "x.h2", "x.w")


def _ranked(pairs: DataFrame, *by: str) -> DataFrame:
    """doc_id, th, p and r for the rows whose pair is another's too: r orders as the pairs do."""
    shared = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    ranks = saved(shared.orderBy(*by).withColumn("r", F.monotonically_increasing_id()), "ranks")
    out = saved(pairs.join(ranks, list(by)).select(*KEY, "p", "r"), "suffixes")
    discard(ranks)
    return out


def suffix_ranks(lines: DataFrame, longest: int) -> list[DataFrame]:
    """By level k, the rank of each suffix by its first 2 ** k lines, while that is within longest."""
    levels = [_ranked(lines, "h", "h2")]
    while 2 << (len(levels) - 1) <= longest:
        step = 1 << (len(levels) - 1)
        own = levels[-1]
        after = own.select(*KEY, (F.col("p") - step).alias("p"), F.col("r").alias("r2"))
        levels.append(_ranked(own.withColumnRenamed("r", "r1").join(_null_safe(after), _on(own, KEY + ["p"])).drop(*[f"_{c}" for c in KEY + ["p"]]), "r1", "r2"))
    return levels


def _null_safe(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in [*KEY, "p"]})


def _on(df: DataFrame, columns: list[str]) -> Column:
    on = F.col(columns[0]).eqNullSafe(F.col(f"_{columns[0]}"))
    for c in columns[1:]:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return on


def _shortest_runs(shared: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, p and m: the shortest runs of min_words or more from each line and up to each line."""
    doc = Window.partitionBy(*KEY).orderBy("p")
    rows = shared.withColumn("island", F.col("p") - F.row_number().over(doc)).select(*KEY, "island", "p", "w")
    island = Window.partitionBy(*KEY, "island").orderBy("p")
    rows = rows.withColumn("before", F.sum("w").over(island) - F.col("w")).withColumn("last", F.lead("p").over(island).isNull())
    # Places between lines: before each, and after the last.
    place = F.struct(F.col("p").alias("p"), F.col("before").alias("at"))
    end = F.struct((F.col("p") + 1).alias("p"), (F.col("before") + F.col("w")).alias("at"))
    places = rows.select(*KEY, "island", F.explode(F.when(F.col("last"), F.array(place, end)).otherwise(F.array(place))).alias("x")).select(*KEY, "island", "x.p", "x.at")
    # Frames that begin with the partition are summed up as they grow; ahead reads from the end.
    by = Window.partitionBy(*KEY, "island")
    ahead = F.min("p").over(by.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -min_words))
    behind = F.max("p").over(by.orderBy("at").rangeBetween(Window.unboundedPreceding, -min_words))
    places = places.select(*KEY, "p", ahead.alias("ahead"), behind.alias("behind"))
    runs = F.array(F.struct(F.col("p").alias("p"), (F.col("ahead") - F.col("p")).alias("m")), F.struct(F.col("behind").alias("p"), (F.col("p") - F.col("behind")).alias("m")))
    runs = places.select(*KEY, F.explode(runs).alias("x")).select(*KEY, "x.p", "x.m")
    return runs.where("p IS NOT NULL AND m IS NOT NULL").distinct()


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (hash of the text) and deleted (numbers of lines, from 0), for documents that lose lines."""
    lines = saved(_positions(documents), "lines")
    often = saved(lines.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "h2"), "often")
    # Rows equal in doc_id and text have the same places: once is enough.
    shared = saved(lines.join(often, ["h", "h2"], "left_semi").dropDuplicates([*KEY, "p"]), "shared-lines")
    discard(lines, often)
    runs = saved(_shortest_runs(shared, min_words), "runs")
    longest = runs.agg(F.max("m")).collect()[0][0] or 0
    gone, levels, made = None, suffix_ranks(shared, longest) if longest else [], []
    for k, ranks in enumerate(levels):
        own = runs.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k))
        head = _null_safe(ranks).withColumnRenamed("r", "r1")
        own = own.join(head, _on(own, [*KEY, "p"])).select(*KEY, "p", "m", "r1", (F.col("p") + F.col("m") - (1 << k)).alias("tail"))
        tail = _null_safe(ranks).withColumnsRenamed({"r": "r2", "_p": "_tail"})
        own = own.join(tail, _on(own, [*KEY, "tail"])).select(*KEY, "p", "m", "r1", "r2")
        at = F.struct("doc_id", "th", "p")
        own = saved(own, "runs")
        interval = own.groupBy("m", "r1", "r2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("m", "r1", "r2", "first")
        interval = saved(interval, "intervals")  # by itself, so that a run that very many repeat can be split
        made += [own, interval]
        later = own.join(interval, ["m", "r1", "r2"]).where(~at.eqNullSafe(F.col("first"))).select(*KEY, "p", "m")
        gone = later if gone is None else gone.unionByName(later)
    if gone is None:
        return shared.limit(0).groupBy(*KEY).agg(F.collect_list("line").alias("deleted"))
    taken = gone.select(*KEY, F.explode(F.sequence("p", F.col("p") + F.col("m") - 1)).alias("p")).distinct()
    number = _null_safe(shared.select(*KEY, "p", "line"))
    out = taken.join(number, _on(taken, [*KEY, "p"])).groupBy(*KEY).agg(F.array_sort(F.collect_set("line")).alias("deleted"))  # of one text
    out = saved(out, "deleted-lines")
    discard(shared, runs, *levels, *made)
    return out


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Delete later copies of repeated line runs from the text of each row; adds n_lines and deleted.

    The order of the corpus is that of doc_id, nulls first, then of the text's hash. Lines end with a
    line feed and are compared as they are; blank lines belong to no run and stay. Null texts stay
    null, texts without repeats stay as they are, and a text that is one later copy becomes empty.
    Rows equal in doc_id and text are one document: all lose the same lines. Columns named n_lines,
    deleted and th in the input are replaced. An empty table gives an empty one.
    """
    documents = documents.drop("n_lines", "deleted", "th")
    names = documents.columns
    # All columns of a row go along in one, so that no name among them meets one of those used here.
    documents = documents.select("doc_id", "text", F.xxhash64("text").alias("th"), F.struct("*").alias("row"))
    gone = repeated_lines(documents.drop("row"), min_words).withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"})
    # What is deleted grows with the corpus, so it isn't broadcast, however little it is.
    out = documents.join(gone.hint("merge"), _on(documents, KEY), "left")
    lines = _line_array(F.col("text"))
    kept = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("deleted")), lambda k: F.get(x, k)), "\n"))[0]
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    text = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*columns, n.alias("n_lines"), F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, i - 1 AS line, l[i] AS t, len(list_filter(string_split(translate(l[i], chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda w: w <> '')) AS w
  FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM x WHERE w > 0),
often AS (SELECT t FROM p GROUP BY t HAVING count(*) > 1),
q AS (SELECT p.* FROM p WHERE t IN (SELECT t FROM often)),
runs AS (SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.w >= 50 GROUP BY ALL
  UNION SELECT b.doc_id, max(a.p) AS s, b.p AS e FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.p),
named AS (SELECT r.doc_id, s, e, string_agg(q.t, chr(10) ORDER BY q.p) AS run FROM runs r JOIN q ON q.doc_id = r.doc_id AND q.p BETWEEN s AND e GROUP BY ALL HAVING count(*) = e - s + 1),
marked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM named),
gone AS (SELECT DISTINCT m.doc_id, q.line FROM marked m JOIN q ON q.doc_id = m.doc_id AND q.p BETWEEN s AND e WHERE k > 1),
per AS (SELECT doc_id, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS deleted, list(line) AS ls FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0) AS n_lines, coalesce(deleted, '') AS deleted,
  sha256(array_to_string(list_filter(l, lambda v, i: ls IS NULL OR NOT list_contains(ls, i - 1)), chr(10))) AS text_sha256
FROM d LEFT JOIN per USING (doc_id)"""
