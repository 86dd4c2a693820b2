"""Running values over one order that spread over any number of tasks.

A window keyed by a performance alone puts the whole performance into one task. Here rows are dealt out
by ranges of their keys and their order, so that a key of any length takes as many ranges as it fills.
Every range is a window of its own; what it hands on (its sums, its last value, where its last reset
leads) is one row, and these rows are combined in turn. Of all ranges only those whose key began in an
earlier one need what was handed on: fewer rows than there are ranges, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.tables import saved

Key = Column | str


def _column(c: Key) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranged(rows: DataFrame, order: Sequence[Key], keys: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """rows as a written table with _range, which rises with keys and then order.

    Rows equal in both share a range, so order should tell rows apart. The table is written because
    ranges drawn again for a lost task could differ.
    """
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(rows.repartitionByRange(n, *map(_column, keys), *map(_column, order)).withColumn("_range", F.spark_partition_id()), "ranges")


def _handed_on(table: DataFrame, keys: Sequence[str], state: Mapping[str, Column], carried: Mapping[str, Column]) -> DataFrame:
    """For each range whose key began before it: carried, windows over the states of that key's ranges."""
    per_range = table.groupBy(*keys, "_range").agg(*[c.alias(name) for name, c in state.items()])
    began = F.row_number().over(Window.partitionBy(*keys).orderBy("_range")) > 1
    return per_range.select(*keys, "_range", began.alias("_later"), *[c.alias(name) for name, c in carried.items()]).where("_later").drop("_later")


def _with(table: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with what its ranges were handed, null in a key's first range. carry has fewer rows than there are ranges."""
    carry = carry.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_range": "_r"})
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return table.join(F.broadcast(carry), same, "left").drop("_r", *[f"_k{i}" for i in range(len(keys))])


def _ranges(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_range")


_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def running(rows: DataFrame, order: Sequence[Key], sums: Mapping[str, Key], keys: Sequence[str] = (), n: int | None = None, before: bool = False) -> DataFrame:
    """rows with running sums by name, over the rows of the same keys up to each row, or with before up to the one before it.

    Nulls count as zero. Rows equal in order are taken in any order.
    """
    table = ranged(rows.withColumns({f"_s_{name}": F.coalesce(_column(c), F.lit(0)) for name, c in sums.items()}), order, keys, n)
    carry = _handed_on(table, keys, {f"_t_{s}": F.sum(f"_s_{s}") for s in sums}, {f"_c_{s}": F.sum(f"_t_{s}").over(_ranges(keys).rowsBetween(*_BEFORE)) for s in sums})
    own = Window.partitionBy("_range", *keys).orderBy(*map(_column, order)).rowsBetween(*_UP_TO)
    out = _with(table, carry, keys)
    for s in sums:
        total = F.sum(f"_s_{s}").over(own) + F.coalesce(F.col(f"_c_{s}"), F.lit(0))
        out = out.withColumn(s, total - F.col(f"_s_{s}") if before else total)
    return out.drop("_range", *[f"{p}{s}" for s in sums for p in ("_s_", "_c_")])


def numbered(rows: DataFrame, order: Sequence[Key], keys: Sequence[str] = (), out: str = "rank", n: int | None = None) -> DataFrame:
    """rows with their number by order among those of the same keys, from 1."""
    return running(rows, order, {out: F.lit(1).cast("long")}, keys, n)


def running_with_resets(rows: DataFrame, step: str, anchor: str, order: str, out: str, keys: Sequence[str] = ("perf_id",), n: int | None = None) -> DataFrame:
    """relops.running_with_resets over ranges: a running sum of step before each row that starts anew from anchor wherever that isn't null.

    A range hands on its sum of steps and, where it has an anchor, the value that its last one leads to.
    """
    table = ranged(rows, [order], keys, n)
    own = Window.partitionBy("_range", *keys).orderBy(order)
    table = table.withColumn("_island", F.count(F.col(anchor)).over(own))
    island = Window.partitionBy("_range", *keys, "_island").orderBy(order)
    since = F.coalesce(F.sum(step).over(island.rowsBetween(*_BEFORE)), F.lit(0.0))
    table = table.withColumn("_base", F.first(anchor).over(island.rowsBetween(*_UP_TO))).withColumn("_since", since)
    after = F.col("_base") + F.col("_since") + F.coalesce(F.col(step), F.lit(0.0))
    per_range = {"_total": F.coalesce(F.sum(step), F.lit(0.0)), "_tail": F.max_by(after, F.struct("_island", order))}
    # The same running sum once more, over ranges: one with an anchor starts anew from its tail.
    states = table.groupBy(*keys, "_range").agg(*[c.alias(k) for k, c in per_range.items()])
    states = states.withColumn("_run", F.count("_tail").over(_ranges(keys)))
    run = Window.partitionBy(*keys, "_run").orderBy("_range").rowsBetween(*_UP_TO)
    states = states.withColumn("_after", F.sum(F.coalesce("_tail", "_total")).over(run))
    states = states.select(*keys, "_range", F.lag("_after").over(_ranges(keys)).alias("_carry")).where("_carry IS NOT NULL")
    done = _with(table, states, keys)
    base = F.when(F.col("_island") > 0, F.col("_base")).otherwise(F.coalesce("_carry", F.lit(0.0)))
    return done.withColumn(out, base + F.col("_since")).drop("_range", "_island", "_base", "_since", "_carry")


def asof(left: DataFrame, right: DataFrame, columns: list[str], at: str = "date", prefix: str = "", keys: Sequence[str] = ("perf_id",), n: int | None = None) -> DataFrame:
    """relops.asof over ranges: to each row of left the columns of the last row of right at or before it.

    A range hands on its last row of right. Rows of left at one place are dealt out by what they hold.
    """
    kind = right.select(F.struct(*columns).alias("x")).schema["x"].dataType
    plain = [c for c, t in left.dtypes if "map<" not in t and "variant" not in t]
    l = left.withColumn("_l", F.struct("*")).select(*keys, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"), F.xxhash64(*plain).alias("_mix"), "_l")
    r = right.select(*keys, F.col(at).cast("double").alias("_at"), F.lit(0).alias("_side"), F.struct(*columns).alias("_v"), F.lit(0).cast("long").alias("_mix"))
    order = ["_at", "_side", F.col("_v").asc_nulls_first(), "_mix"]
    table = ranged(l.unionByName(r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType))), order, keys, n)
    last = F.max_by(F.when(F.col("_side") == 0, F.col("_v")), F.when(F.col("_side") == 0, F.struct("_at", "_v")))
    carry = _handed_on(table, keys, {"_last": last}, {"_before": F.last("_last", ignorenulls=True).over(_ranges(keys).rowsBetween(*_BEFORE))})
    own = Window.partitionBy("_range", *keys).orderBy(*map(_column, order)).rowsBetween(*_UP_TO)
    out = _with(table.withColumn("_v", F.last("_v", ignorenulls=True).over(own)).where("_side = 1"), carry, keys)
    value = F.coalesce("_v", "_before")
    return out.withColumn("_v", value).select("_l.*", *[F.col("_v")[c].alias(prefix + c) for c in columns])
