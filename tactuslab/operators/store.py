"""The store of instructions: one for each performance, scope and date of a kind, later writers winning.

A scope is a part's number, or null for all parts; a part's lookup doesn't fall back to these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.operators import relops

KEY = ("perf_id", "scope", "date")


def _latest(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Of rows with one key the last by order."""
    w = Window.partitionBy(*KEY).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def put(have: DataFrame, rows: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """have with rows: one takes the place of what has its key, and of two with one key the later by order (else by all they hold) stays.

    Columns that rows lack are null. One window over both sides does it, so neither is looked up in the other.
    """
    lacking = {c: F.lit(None).cast(t) for c, t in have.dtypes if c not in rows.columns}
    order = order or [c for c, t in rows.dtypes if c not in KEY and not t.startswith("map")]
    ranked = rows.withColumns(lacking).withColumn("_rank", F.struct(*order) if order else F.struct(F.lit(1)))
    kind = ranked.schema["_rank"].dataType
    both = have.withColumns({"_new": F.lit(0), "_rank": F.lit(None).cast(kind)}).unionByName(ranked.select(*have.columns, F.lit(1).alias("_new"), "_rank"))
    old_twice = F.max("_new").over(Window.partitionBy(*KEY))
    kept = both.withColumn("_wins", old_twice).where("_wins = 0 OR _new = 1")
    return kept.where("_new = 0").unionByName(_latest(kept.where("_new = 1"), ["_rank"])).select(*have.columns)


def remove(have: DataFrame, keys: DataFrame) -> DataFrame:
    """have without what stands at one of keys (perf_id, scope, date); a null scope is the scope of all parts."""
    k = keys.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    same = (F.col("perf_id") == F.col("_perf_id")) & F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("date") == F.col("_date"))
    return have.join(k, same, "left_anti")


def in_force(points: DataFrame, have: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """points (perf_id, scope, date and more) with columns of the instruction in force in their own scope: the last at or before them."""
    return relops.asof(points, have, columns, prefix=prefix, keys=("perf_id", "scope"))
