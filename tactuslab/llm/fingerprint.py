"""Document fingerprints: threshold-scaled sketches.

A text's shingles are runs of five words, its whole sequence where it has fewer. Every shingle hash
below one FRACTIONth of the range is retained and no other, so sketches of unequal documents stay
comparable, the union of two is the sketch of both texts' shingles, and the retained part estimates
similarity and containment. A text of few shingles may retain none: beside its empty sketch stands
its smallest hash, which tells it from others but takes no part in unions or estimates.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.llm.common import free

SHINGLE = 5
#: One of so many hashes is retained.
FRACTION = 8
#: Hashes below this are retained.
TOP = -(1 << 63) + (1 << 64) // FRACTION
#: Buckets of ids for each shuffle partition, in which neighbours are found.
BUCKETS = 4


def sketch(text: Column) -> Column:
    """sketch: the retained hashes of a text, ascending; fallback: its smallest hash where none is retained, null
    without words. Letters A-Z count as a-z.
    """
    spaced = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return F.transform(F.array(words), _retained)[0]


def _retained(words: Column) -> Column:
    # The first width - 1 words of the rest of the array, paired by place with the words themselves.
    n = F.size(words)
    hashes = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(SHINGLE)])))
    hashes = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.coalesce(hashes, F.array(F.xxhash64(words))))

    def kept(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < TOP)))
        return F.struct(low.alias("sketch"), F.when(F.size(low) == 0, F.array_min(h)).alias("fallback"))

    return F.transform(F.array(hashes), kept)[0]


def written(hashes: Column, fallback: Column | None = None) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash; for an empty one the fallback's, which is none below TOP."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    text = F.array_join(F.transform(hashes, digits), "")
    return text if fallback is None else F.when(F.size(hashes) == 0, F.coalesce(digits(fallback), F.lit(""))).otherwise(text)


def read(fingerprint: Column) -> Column:
    """The retained hashes of a written sketch."""
    n = (F.length(fingerprint) / 16).cast("int")
    part = lambda k: F.conv(F.substring(fingerprint, k * 16 + 1, F.lit(16)), 16, -10).cast("long")
    return F.when(n > 0, F.filter(F.transform(F.sequence(F.lit(0), n - 1), part), lambda h: h < TOP)).otherwise(F.array().cast("array<bigint>"))


def likeness(a: Column, b: Column, fallback_a: Column | None = None, fallback_b: Column | None = None) -> Column:
    """The estimated Jaccard similarity of two texts. Of two empty sketches the fallbacks tell: 1 if they are equal, else 0."""
    union = F.size(F.array_union(a, b))
    same = F.lit(1.0) if fallback_a is None else F.when(fallback_a.eqNullSafe(fallback_b), 1.0).otherwise(0.0)
    return F.when(union == 0, same).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b holds; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Add sketch and fallback to each document; a null text has those of an empty one."""
    rows = documents.drop("sketch", "fallback").withColumn("_sketch", sketch(F.coalesce("text", F.lit(""))))
    return rows.select("*", "_sketch.sketch", "_sketch.fallback").drop("_sketch")


def _place(bounds: list, value: Column) -> Column:
    """How many of the ascending bounds lie below value, by a search among every so-manieth and one behind it."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    below = lambda some: F.size(F.filter(some, lambda b: b < value))
    groups = F.array(*[F.array(*map(F.lit, bounds[k : k + step])) for k in range(0, len(bounds), step)])
    group = F.greatest(below(F.array(*map(F.lit, bounds[::step]))), F.lit(1))
    return F.coalesce((group - 1) * step + below(F.element_at(groups, group)), F.lit(0))


def with_next(documents: DataFrame, columns: list[str], buckets: int | None = None, prepared: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Add next_<column>: the columns of the next row by ascending doc_id; after the last comes the first.

    Rows are dealt to buckets of neighbouring ids between quantiles; each bucket is ordered by itself,
    and the first row of each, as many as buckets, follows the last of the one before. doc_id is a
    number. Equal ids are ordered by the columns and stay in one bucket, so an id isn't meant to be
    repeated without end; null ids come first. prepared is applied to the rows before all else.
    """
    spark = documents.sparkSession
    at, following_row, first_row, of, least_id, before_it = free(prepared(documents), "_bucket", "_next", "_first", "_b", "_least", "_before")
    n = buckets or BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fractions = [k / n for k in range(1, n)]
    quantiles = documents.agg(F.percentile_approx("doc_id", fractions, 10 * n)).collect()[0][0] if n > 1 else []
    bucket = _place(sorted(set(quantiles or [])), F.col("doc_id"))
    own = documents.select(bucket.alias("_bucket"), "doc_id")
    rows = prepared(documents).withColumn(at, bucket)
    order = Window.partitionBy(at).orderBy(F.col("doc_id").asc_nulls_first(), *columns)
    following = F.lead(F.struct(*columns)).over(order)
    # Which rows come first is found from ids alone; only these, one or few for each bucket, are then looked up whole.
    least = F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id"))
    ids = own.groupBy("_bucket").agg(least.alias("least")).orderBy("_bucket").collect()
    before = [(r["_bucket"], r["least"], ids[k - 1]["_bucket"]) for k, r in enumerate(ids)]  # around in a ring
    known = F.broadcast(spark.createDataFrame(before, f"{of} int, {least_id} {dict(documents.dtypes)['doc_id']}, {before_it} int"))
    first = documents.join(known, F.col("doc_id").eqNullSafe(F.col(least_id)), "left_semi")
    heads = prepared(first).join(known, F.col("doc_id").eqNullSafe(F.col(least_id)))
    heads = heads.groupBy(F.col(before_it).alias(at)).agg(F.min(F.struct(*columns)).alias(first_row))
    out = rows.withColumn(following_row, following).join(heads, at).withColumn(following_row, F.coalesce(following_row, first_row))
    return out.select(*documents.columns, *[c for c in rows.columns if c not in (*documents.columns, at)], *[F.col(following_row)[c].alias(f"next_{c}") for c in columns])


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each document (doc_id, text) and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    next document, by ascending doc_id, a number. Null texts count as empty; repeated rows are followed by each
    other. Other columns aren't read; an empty table gives an empty one.
    """
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(own, ["text", "sketch", "fallback"], prepared=fingerprints)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "fallback", "next_sketch", "next_fallback")
    rows = rows.withColumn("_e", sketch(F.col("edited")))
    own, own_fallback, of_edited, edited_fallback = F.col("sketch"), F.col("fallback"), F.col("_e.sketch"), F.col("_e.fallback")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written(own, own_fallback).alias("fingerprint"), written(of_edited, edited_fallback).alias("edited_fingerprint"),
        likeness(own, of_edited, own_fallback, edited_fallback).alias("near_edited"), likeness(own, F.col("next_sketch"), own_fallback, F.col("next_fallback")).alias("near_next"),
    )
