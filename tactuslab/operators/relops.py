"""Relational building blocks: chords, as-of lookups, frames with anchors, islands, range self-joins, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactuslab.tables import discard, saved

#: Groups of more points than this are clustered by cells over all tasks; smaller ones many at a time in one.
FEW_POINTS = 2000


def by_date(*more: str) -> Window:
    return Window.partitionBy("perf_id", *more).orderBy("date")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out by performance for work that costs far more than its rows weigh: a number of
    partitions of its own, which adaptive execution doesn't join by their few bytes.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, "perf_id")


def whole_groups(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], work: Callable[[pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """work over whole groups of keys (perf_id first), as many at a time as an Arrow batch holds, their rows in order.

    A task holds one batch and the group that goes on in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        same = lambda x, i, y, j: all(x.column(k)[i].as_py() == y.column(k)[j].as_py() for k in keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and not same(held[-1], held[-1].num_rows - 1, batch, 0):
                yield from work(pa.Table.from_batches(held)).to_batches()
                held = []
            cut = int(group_starts([batch.column(k) for k in keys])[-1])
            if cut:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return spread(rows).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def group_starts(keys: list) -> np.ndarray:
    """Where each run of equal keys begins; null is a key like any other."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        null, v = (np.asarray(x) for x in (k.is_null(), k.fill_null(0)))
        new[1:] |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def chords(notes: DataFrame, *more: str) -> DataFrame:
    """One row for each date of a performance (and each of more): how many notes, and means over them."""
    return notes.groupBy("perf_id", *more, "date").agg(
        F.count(F.lit(1)).alias("n_notes"),
        F.min_by("onset", "seq").alias("first_onset"),
        F.avg("velocity").alias("mean_velocity"),
        mean_in_order(F.col("onset"), "seq").alias("mean_onset"),
    )


def mean_in_order(x: Column, *order: str) -> Column:
    """The mean of a group's values, added up by order: avg adds up as the rows come, so that its last digits differ between runs and table sizes."""
    return _mean(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*order, x.cast("double").alias("x"))))), "x")


def means_in_order(columns: tuple[str, ...], *order: str) -> list[Column]:
    """mean_in_order of several columns, over one sorted array."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).cast("double").alias(c) for c in columns])))
    known = lambda c: F.filter(rows, lambda r: r[c].isNotNull())
    return [_mean(known(c), c).alias(c) for c in columns]


def _mean(rows: Column, name: str) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + r[name]) / F.nullif(F.size(rows), F.lit(0))


def with_end(instructions: DataFrame, ends: DataFrame, *more: str) -> DataFrame:
    """Instructions with end_date: the next one's date, the last with the performance's end_date in ends."""
    w = Window.partitionBy("perf_id", *more).orderBy("date")
    rows = instructions.withColumn("_next", F.lead("date").over(w)).withColumn("frame", F.row_number().over(w)).join(ends, "perf_id", "left")
    return rows.withColumn("end_date", F.coalesce("_next", F.col("end_date").cast("double"))).withColumn("is_last", F.col("_next").isNull()).drop("_next")


def ends(notes: DataFrame) -> DataFrame:
    return notes.groupBy("perf_id").agg(F.max(F.col("date") + F.col("duration")).alias("end_date"))


def asof(left: DataFrame, right: DataFrame, columns: list[str], at: str = "date", prefix: str = "", keys: tuple[str, ...] = ("perf_id",)) -> DataFrame:
    """To each row of left the columns of the last row of right at or before it, by one sort of both.

    columns come back under prefix. Of equal places in right the one with the largest columns counts.
    """
    value = F.struct(*columns)
    l = left.withColumn("_l", F.struct("*")).select(*keys, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(_kind(right, columns)).alias("_v"), "_l")
    r = right.select(*keys, F.col(at).cast("double").alias("_at"), F.lit(0).alias("_side"), value.alias("_v")).withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_l.*", *[F.col("_v")[c].alias(prefix + c) for c in columns])


def _kind(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("x")).schema["x"].dataType


def running_with_resets(rows: DataFrame, step: str, anchor: str, order: str, out: str, keys: tuple[str, ...] = ("perf_id",)) -> DataFrame:
    """A running sum of step before each row that starts anew from anchor wherever that isn't null."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_island", F.count(F.col(anchor)).over(w))
    own = Window.partitionBy(*keys, "_island").orderBy(order)
    before = F.coalesce(F.sum(step).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    base = F.coalesce(F.first(anchor).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0))
    return rows.withColumn(out, base + before).drop("_island")


def islands(rows: DataFrame, starts: Column, order: str, out: str = "island", keys: tuple[str, ...] = ("perf_id",)) -> DataFrame:
    """Number runs of rows: a new one begins wherever starts holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn(out, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))


def _directions(dims: dict) -> list[dict[str, int]]:
    """Half of the ways from a cell to its neighbours: in each dimension that has an extent back, none or forth, and the first move forth."""
    free = [d for d, e in dims.items() if isinstance(e, Column) or e > 0]
    ways = [dict(zip(free, step, strict=True)) for step in product((0, 1, -1), repeat=len(free))]
    return [w for w in ways if next((x for x in w.values() if x), 0) > 0]


def touching_cells(points: DataFrame, dims: dict[str, float | Column], keys: tuple[str, ...] = ("perf_id",), index: str = "index") -> tuple[DataFrame, DataFrame]:
    """points (known in all dimensions) with node, their cell's smallest index, and pairs a, b of nodes whose cells hold points that touch.

    Points touch if they are no further apart than epsilon in every dimension; a cell is epsilon wide in each
    dimension, so all its points touch each other, and one pair is enough to tie two cells. Cells that differ in
    one dimension are tied by their outermost points. Across a corner, the outermost points towards it are
    tried first and cells whose bounds are too far apart left out; what is open then is told by a sweep: by
    falling first dimension the furthest second one reached so far. Only where three or more dimensions differ are
    points that pass the sweep compared in pairs. Rows grow with points and with cells, not with pairs of points.
    """
    known = F.lit(True)
    for d in dims:
        known = known & F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double"))
    rows = points.where(known)
    extent = lambda d: dims[d] if isinstance(dims[d], Column) else F.lit(float(dims[d]))
    rows = rows.withColumns({f"_e_{d}": extent(d).cast("double") for d in dims}).withColumns({f"_x_{d}": F.col(d).cast("double") for d in dims})
    rows = rows.withColumns({f"_c_{d}": F.when(F.col(f"_e_{d}") > 0, F.floor(F.col(f"_x_{d}") / F.nullif(F.col(f"_e_{d}"), F.lit(0.0))).cast("double")).otherwise(F.col(f"_x_{d}")) for d in dims})
    cell = [f"_c_{d}" for d in dims]
    rows = rows.withColumn("node", F.min(index).over(Window.partitionBy(*keys, *cell)))
    ways = _directions(dims)
    place = F.struct(*[F.col(f"_x_{d}").alias(d) for d in dims])

    def along(way: dict[str, int]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"_x_{d}") / F.nullif(F.col(f"_e_{d}"), F.lit(0.0)) * x for d, x in way.items() if x], F.lit(0.0))

    sides = [x for k, w in enumerate(ways) for x in (F.max_by(place, along(w)).alias(f"_far_{k}"), F.min_by(place, along(w)).alias(f"_near_{k}"))]
    bounds = [x for d in dims for x in (F.min(f"_x_{d}").alias(f"_lo_{d}"), F.max(f"_x_{d}").alias(f"_hi_{d}"), F.max(f"_e_{d}").alias(f"_e_{d}"))]
    cells = saved(rows.groupBy(*keys, *cell, "node").agg(*bounds, *sides), "cells")
    rows = saved(rows, "cell-points")
    if not ways:
        return rows.select(*points.columns, "node"), cells.select(*keys, F.col("node").alias("a"), F.col("node").alias("b")).where(F.lit(False))

    step = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(w.get(d, 0))).alias(d) for d in dims]) for k, w in enumerate(ways)]))
    one = cells.select("*", step.alias("_w"))
    one = one.withColumns({f"_to_{d}": F.col(f"_c_{d}") + F.col("_w")[d] for d in dims}).withColumn("_out", F.element_at(F.array(*[F.col(f"_far_{k}") for k in range(len(ways))]), F.col("_w.k") + 1))
    one = one.select(*keys, *[f"_to_{d}" for d in dims], F.col("node").alias("a"), "_w", "_out", *[F.col(f"_{x}_{d}").alias(f"_a{x}_{d}") for d in dims for x in ("lo", "hi")])
    other = cells.select(*keys, *[F.col(c).alias(f"_to_{d}") for c, d in zip(cell, dims, strict=True)], F.col("node").alias("b"), F.array(*[F.col(f"_near_{k}") for k in range(len(ways))]).alias("_in"), *[f"_{x}_{d}" for d in dims for x in ("lo", "hi", "e")])
    pairs = one.join(other, [*keys, *[f"_to_{d}" for d in dims]]).withColumn("_into", F.element_at("_in", F.col("_w.k") + 1))
    apart, touch = F.lit(False), F.lit(True)
    for d in dims:
        gap = F.when(F.col("_w")[d] > 0, F.col(f"_lo_{d}") - F.col(f"_ahi_{d}")).when(F.col("_w")[d] < 0, F.col(f"_alo_{d}") - F.col(f"_hi_{d}")).otherwise(F.lit(0.0))
        apart = apart | (gap > F.col(f"_e_{d}"))
        touch = touch & (F.abs(F.col("_out")[d] - F.col("_into")[d]) <= F.col(f"_e_{d}"))
    turns = reduce(lambda a, b: a + b, [F.abs(F.col("_w")[d]) for d in dims])
    pairs = pairs.where(~apart).select(*keys, "a", "b", "_w", touch.alias("_tied"), turns.alias("_turns"), *[f"_{x}_{d}" for d in dims for x in ("lo", "hi", "e")], *[f"_a{x}_{d}" for d in dims for x in ("lo", "hi")])
    pairs = saved(pairs, "cell-pairs")
    tied = pairs.where("_tied").select(*keys, "a", "b")
    found = [tied]
    if max(sum(map(abs, w.values())) for w in ways) > 1:
        found.append(_across_corners(rows, pairs.where("NOT _tied AND _turns > 1"), dims, keys, index))
    return rows.select(*points.columns, "node"), reduce(DataFrame.unionByName, found)


def _across_corners(rows: DataFrame, pairs: DataFrame, dims: dict, keys: tuple[str, ...], index: str) -> DataFrame:
    """Those of pairs of cells that hold points which touch, by a sweep over the points that lie near the other cell's bounds."""
    mirrored = lambda d: F.when(F.col("_w")[d] < 0, -F.col(f"_x_{d}")).otherwise(F.col(f"_x_{d}"))
    values = {f"_y_{d}": mirrored(d) for d in dims}
    own = rows.select(*keys, "node", F.col(index).alias("_i"), *[f"_x_{d}" for d in dims])

    def near(side: str, low: str, high: str) -> DataFrame:
        some = own.withColumnRenamed("node", side).join(pairs, [*keys, side])
        for d in dims:
            up, down = F.col(f"_x_{d}") >= F.col(f"{low}_{d}") - F.col(f"_e_{d}"), F.col(f"_x_{d}") <= F.col(f"{high}_{d}") + F.col(f"_e_{d}")
            some = some.where(up & down)
        reach = {f"_y_{d}": v + (F.col(f"_e_{d}") if side == "a" else F.lit(0.0)) for d, v in zip(dims, values.values(), strict=True)}
        turned = F.filter(F.array(*[F.when(F.col("_w")[d] != 0, F.struct(reach[f"_y_{d}"].alias("y"))) for d in dims]), lambda x: x.isNotNull())
        return some.select(*keys, "a", "b", F.lit(side == "b").alias("_b"), "_i", "_turns", turned.alias("_t"), *[f"_x_{d}" for d in dims], *[f"_e_{d}" for d in dims])

    both = near("a", "_lo", "_hi").unionByName(near("b", "_alo", "_ahi"))
    both = both.withColumn("_first", F.col("_t")[0]["y"]).withColumn("_second", F.col("_t")[1]["y"])
    sweep = Window.partitionBy(*keys, "a", "b").orderBy(F.desc("_first"), "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_reach", F.max(F.when(~F.col("_b"), F.col("_second"))).over(sweep))
    hit = swept.where(F.col("_b") & (F.col("_second") <= F.col("_reach")))
    flat = hit.where("_turns = 2").select(*keys, "a", "b").distinct()
    if sum(1 for e in dims.values() if isinstance(e, Column) or e > 0) < 3:
        return flat
    left = both.where("NOT _b AND _turns > 2").select(*keys, "a", "b", *[F.col(f"_x_{d}").alias(f"_p_{d}") for d in dims])
    close = F.lit(True)
    for d in dims:
        close = close & (F.abs(F.col(f"_x_{d}") - F.col(f"_p_{d}")) <= F.col(f"_e_{d}"))
    deep = hit.where("_turns > 2").join(left, [*keys, "a", "b"]).where(close).select(*keys, "a", "b").distinct()
    return flat.unionByName(deep)


def components(points: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("perf_id",), index: str = "index") -> DataFrame:
    """points with root: the smallest index each reaches over pairs (a, b), by label spreading and pointer jumping.

    Every step is written to the shared folder; steps grow as the logarithm of the longest path.
    """
    both = saved(pairs.select(*keys, "a", "b").unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "pairs")
    label = saved(points.select(*keys, F.col(index).alias("a"), F.col(index).alias("root"), F.lit(True).alias("moved")), "roots")
    while label.where("moved").limit(1).count():
        near = both.join(label.select(*keys, F.col("a").alias("b"), "root"), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("root").alias("m"))
        step = label.join(near, [*keys, "a"], "left").select(*keys, "a", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = label.select(*keys, F.col("a").alias("root"), F.col("root").alias("far"))
        step = step.join(jump, [*keys, "root"]).select(*keys, "a", "old", F.least("root", "far").alias("root"))
        before, label = label, saved(step.select(*keys, "a", "root", (F.col("root") != F.col("old")).alias("moved")), "roots")
        discard(before)
    discard(both)
    return points.join(label.select(*keys, F.col("a").alias(index), "root"), [*keys, index], "left")


def _in_a_row(points: DataFrame, dim: str, epsilon: float, keys: tuple[str, ...], index: str) -> DataFrame:
    """points with root where there is one dimension: a component ends at each gap of more than epsilon."""
    x = F.col(dim).cast("double")
    known = x.isNotNull() & ~F.isnan(x)
    order = Window.partitionBy(*keys, known).orderBy(x)
    rows = points.withColumn("_known", known).withColumn("_run", F.sum(F.coalesce((x - F.lag(x).over(order) > epsilon).cast("int"), F.lit(0))).over(order))
    root = F.when(F.col("_known"), F.min(index).over(Window.partitionBy(*keys, "_known", "_run"))).otherwise(F.col(index))
    return rows.withColumn("root", root).drop("_known", "_run")


def _touching(group: np.ndarray, xs: list[np.ndarray], es: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that are no further apart than epsilon in every dimension, by a sweep along the first."""
    order = np.lexsort((xs[0], group))
    group, xs, es = group[order], [x[order] for x in xs], [e[order] for e in es]
    here, found = np.arange(len(order)), []
    for step in range(1, len(order)):
        here = here[here + step < len(order)]
        there = here + step
        near = (group[here] == group[there]) & (xs[0][there] - xs[0][here] <= es[0][here])
        here, there = here[near], there[near]
        if not len(here):
            break
        close = np.ones(len(here), bool)
        for x, e in zip(xs[1:], es[1:], strict=True):
            close &= np.abs(x[there] - x[here]) <= e[here]
        found.append((here[close], there[close]))
    a, b = (np.concatenate(side) for side in zip(*found, strict=True)) if found else (here[:0], here[:0])
    return order[a], order[b]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest it reaches over pairs."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _labels(starts: np.ndarray, xs: list[np.ndarray], es: list[np.ndarray]) -> np.ndarray:
    """Labels of rows in order of their index, group after group: clusters from 0 by their first row, -1 alone."""
    n = len(xs[0])
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
    known = np.flatnonzero(~np.any([np.isnan(x) for x in xs], axis=0))
    a, b = _touching(group[known], [x[known] for x in xs], [e[known] for e in es])
    root = _roots(n, known[a], known[b])
    first = (root == np.arange(n)) & (np.bincount(root, minlength=n) > 1)
    before = np.cumsum(first)
    number = before - 1 - (before - first)[starts][group]
    many = first[root]
    return np.where(many, number[root], -1)


def cluster(points: DataFrame, dims: dict[str, float], keys: tuple[str, ...] = ("perf_id",), index: str = "index") -> DataFrame:
    """points with label: clusters of points that touch within a box, numbered by their first index, -1 alone.

    What density clustering with two points a core comes to: every point with a neighbour is a core, so
    clusters are the connected components of two or more. One dimension takes a sort. More take a sweep over
    whole groups, many in one task, and for groups of more than FEW_POINTS the graph of cells that touch, which is
    spread over tasks. Null and NaN are near nothing.
    """
    if len(dims) == 1:
        return _numbered(points, dims, keys, index)
    extra = {}
    for k, (d, e) in enumerate(dims.items()):
        extra |= {f"_x_{k}": F.col(d).cast("double"), f"_e_{k}": (e if isinstance(e, Column) else F.lit(float(e))).cast("double")}

    added, n, limit = list(extra), len(dims), FEW_POINTS

    def work(table: pa.Table) -> pa.Table:
        plain = lambda c: table.column(c).to_numpy().astype(float)
        starts = group_starts([table.column(k) for k in keys])
        sizes = np.diff([*starts, table.num_rows])
        few = np.repeat(sizes <= limit, sizes)
        label = np.zeros(table.num_rows, np.int32)
        if few.any():
            own = np.cumsum([0, *sizes[sizes <= limit]])[:-1]
            label[few] = _labels(own, [plain(f"_x_{k}")[few] for k in range(n)], [plain(f"_e_{k}")[few] for k in range(n)])
        return table.drop_columns(added).append_column("label", pa.array(label)).append_column("_open", pa.array(~few))

    schema = T.StructType([*points.schema.fields, T.StructField("label", T.IntegerType()), T.StructField("_open", T.BooleanType())])
    found = saved(whole_groups(points.withColumns(extra), keys, (index,), work, schema), "clusters")
    done = found.where("NOT _open").drop("_open")
    if not found.where("_open").limit(1).count():
        return done
    return done.unionByName(_numbered(found.where("_open").select(*points.columns), dims, keys, index))


def _numbered(points: DataFrame, dims: dict[str, float], keys: tuple[str, ...], index: str) -> DataFrame:
    """cluster by sorts and joins, whatever the groups' sizes."""
    if len(dims) == 1:
        ((dim, epsilon),) = dims.items()
        found = _in_a_row(points, dim, epsilon, keys, index)
    else:
        placed, pairs = touching_cells(points, dims, keys, index)
        cells = components(placed.select(*keys, F.col("node").alias(index)).distinct(), pairs, keys, index)
        roots = placed.select(*keys, index, "node").join(cells.select(*keys, F.col(index).alias("node"), "root"), [*keys, "node"]).drop("node")
        found = points.join(roots, [*keys, index], "left").withColumn("root", F.coalesce("root", index))
    sizes = found.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    w = Window.partitionBy(*keys).orderBy("root")
    sizes = sizes.withColumn("label", F.row_number().over(w) - 1).drop("_n")
    return found.join(sizes, [*keys, "root"], "left").withColumn("label", F.coalesce("label", F.lit(-1))).drop("root")
