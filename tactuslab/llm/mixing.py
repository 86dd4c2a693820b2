"""Mixing sources to target weights by systematic sampling.

Sources by code point, null last, have the weights 3, 1, 2 in turn and share SHARE times all words. No
source gives more than MOST times its words; what it can't take is shared by the others by weight, which
ends where every source either gives all it may or level * weight. A document of a source with the ratio
r = target / words is expected r times. Its documents are put in order, their expected copies summed up,
one offset added, and a document is emitted once for each whole number that its part of the sum crosses.

Documents are ordered by size, so that those taken are spread evenly over short and long ones and the
words taken differ from the target by about one document. Copies and offset count in whole 2**-30ths, so
a sum of any length crosses exactly. Prefix sums run over ranges (operators.scan): no source, however
large, is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactuslab.llm.common import saved
from tactuslab.operators import scan

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Expected copies are whole numbers of this share.
UNIT = 1 << 30


def size(text: Column) -> Column:
    """How many words a text has; a null one has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source of sizes (source, size).

    By ascending words for each unit of weight, sources give all they may as long as that is no more
    than their share of what is left; both sums that this takes are prefix sums. A null source is one of
    its own, the last. A source without words has the target 0.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = scan.numbered(own, [F.col("source").isNull(), "source"], out="_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = saved(place.withColumn("_w", weight).drop("_place"), "sources")
    words, all_weights = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    most_of = F.col("source_size") * most
    rows = scan.running(rows, [F.col("source_size") / F.col("_w"), F.col("source").isNull(), "source"], {"_before": most_of, "_behind": "_w"}, before=True)
    left = F.lit(words * share) - F.col("_before")
    rows = saved(rows.withColumn("_full", most_of * (F.lit(all_weights) - F.col("_behind")) <= left * F.col("_w")), "sources")
    given, behind = rows.agg(F.coalesce(F.sum(F.when(F.col("_full"), most_of)), F.lit(0)), F.sum(F.when(~F.col("_full"), F.col("_w")))).first()
    level = (words * share - given) / behind if behind else 0.0
    target = F.when(F.col("_full"), most_of.cast("double")).otherwise(F.least(F.lit(level) * F.col("_w"), most_of.cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """An offset of each source in units, the same whenever it is asked for."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") * (UNIT >> 28)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Each document (doc_id, text, source) with its size, source_size, target and copies: how often the mix takes it.

    A null text has the size 0; a null source is one of its own, ordered last. No document is taken
    more than most times. Documents of one size are ordered by doc_id, null first; of rows equal in size
    and id it doesn't matter which is taken, so that the same rows come out whenever it runs. Other columns
    aren't read, whatever they are called; an empty table gives an empty one. Texts are read once.
    """
    rows = saved(documents.select("doc_id", "source", size(F.col("text")).alias("size")), "sizes")
    sources = saved(targets(rows, weights, share, most), "targets")
    placed = scan.numbered(rows, ["size", "doc_id"], ["source"], out="_k")
    known = sources.select(F.col("source").alias("_source"), "source_size", "target")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0.0)).cast("long")
    placed = placed.withColumn("_each", each)
    part = F.col("_each") % UNIT
    # What is left over of offset + (k - 1) * each beyond whole numbers, without ever leaving 62 bits.
    over = (((F.col("_k") - 1) % UNIT) * part + _offset(F.col("source"), seed)) % UNIT
    copies = F.expr(f"_each div {UNIT}") + (over + part >= UNIT).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def emitted(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents themselves, as often as mixed (of mix) takes them; ids have to be unique and not null."""
    often = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_n"))
    rows = documents.join(often, F.col("doc_id") == F.col("_id"))
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(*documents.columns)


def digest(mixed: DataFrame) -> DataFrame:
    """The words that the mix takes of each document, repeats counted."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    weight = "CASE " + " ".join(f"WHEN (place - 1) % {len(WEIGHTS)} = {k} THEN {w}" for k, w in enumerate(WEIGHTS)) + " END"
    return f"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{word}')), 0)::BIGINT AS size FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, ({weight})::BIGINT AS w FROM own),
run AS (SELECT *, coalesce(sum({MOST} * source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  coalesce(sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS behind,
  sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS weights FROM weighed),
judged AS (SELECT *, ({MOST} * source_size * (weights - behind)) <= (total * {SHARE}::DOUBLE - before) * w AS is_full FROM run),
levels AS (SELECT (max(total) * {SHARE}::DOUBLE - coalesce(sum({MOST} * source_size) FILTER (WHERE is_full), 0)::BIGINT) / nullif(sum(w) FILTER (WHERE NOT is_full), 0)::BIGINT AS level FROM judged),
aimed AS (SELECT source, source_size, CASE WHEN is_full THEN ({MOST} * source_size)::DOUBLE ELSE least(level * w, ({MOST} * source_size)::DOUBLE) END AS target FROM judged, levels),
placed AS (SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS k FROM sized),
ratio AS (SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT} + 0.5)::BIGINT ELSE 0 END AS each,
  ('0x' || substr(sha256('{SEED}:' || coalesce(p.source, '')), 1, 7))::BIGINT * {UNIT >> 28} AS u FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  size * (each // {UNIT} + CASE WHEN (((k - 1) % {UNIT}) * (each % {UNIT}) + u) % {UNIT} + each % {UNIT} >= {UNIT} THEN 1 ELSE 0 END) AS taken FROM ratio"""


ORACLE_SQL = _sql()
