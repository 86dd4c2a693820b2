"""Clusters by the graph of cells against all pairs of points."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tactuslab.operators import relops


def _brute(points, eps):
    """Label by index: components of points within eps in all dimensions, numbered by their first index, -1 alone."""
    parent = {i: i for i in points}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [i for i, x in points.items() if all(v is not None and v == v for v in x)]
    for i, j in itertools.combinations(known, 2):
        if all(abs(a - b) <= e for a, b, e in zip(points[i], points[j], eps)):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    size = {}
    for i in points:
        size.setdefault(root(i), []).append(i)
    labels = {r: k for k, r in enumerate(sorted(min(m) for m in size.values() if len(m) > 1))}
    return {i: labels.get(min(size[root(i)]), -1) for i in points}


@pytest.mark.parametrize("d,eps", [(2, (1.0, 0.5)), (2, (1.0, 0.0)), (3, (1.0, 2.0, 0.5)), (4, (1.0, 1.0, 0.0, 0.7)), (2, (0.0, 0.0))])
def test_against_all_pairs(spark, d, eps):
    r = random.Random(d)
    names = [f"x{k}" for k in range(d)]
    rows, want = [], {}
    for perf in range(6):
        reach = (3, 6, 12, 25, 6, 3)[perf]
        points = {}
        for i in range(90):
            grid = perf % 2 == 0  # many points just epsilon apart
            x = tuple(r.choice([None, float("nan")]) if r.random() < 0.01 else (r.randint(-reach * 2, reach * 2) / 2 if grid else r.uniform(-reach, reach)) * (e or 1) for e in eps)
            points[i] = x
            rows.append((perf, i, *x))
        want |= {(perf, i): v for i, v in _brute(points, eps).items()}
    table = spark.createDataFrame(rows, "perf_id int, index int, " + ", ".join(f"{n} double" for n in names))
    got = relops.cluster(table, dict(zip(names, eps))).collect()
    assert {(x["perf_id"], x["index"]): x["label"] for x in got} == want
    by_column = table.withColumns({f"e{k}": F.lit(e) for k, e in enumerate(eps)})
    got = relops.cluster(by_column, {n: F.col(f"e{k}") for k, n in enumerate(names)}).collect()
    assert {(x["perf_id"], x["index"]): x["label"] for x in got} == want


@pytest.mark.parametrize("few", [0, 20, 2000])
def test_groups_of_all_sizes(spark, monkeypatch, few):
    """Small groups go many to a task, large ones by cells; rows come back as they were, with keys that are null or parted over batches."""
    monkeypatch.setattr(relops, "FEW_POINTS", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        r = random.Random(9)
        rows, want = [], {}
        for perf, outer in itertools.product(range(3), range(3)):
            points = {2 * i: (r.uniform(-6, 6), r.uniform(-6, 6)) for i in range(r.choice([1, 5, 30, 40]))}
            rows += [(perf, outer, i, *x, [f"n{i}"]) for i, x in points.items()]
            want |= {(perf, outer, i): (v, [f"n{i}"]) for i, v in _brute(points, (1.0, 0.7)).items()}
        table = spark.createDataFrame(rows, "perf_id long, outer int, index int, x double, y double, ids array<string>")
        got = relops.cluster(table, {"x": 1.0, "y": 0.7}, ("perf_id", "outer")).collect()
        assert {(x["perf_id"], x["outer"], x["index"]): (x["label"], x["ids"]) for x in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_groups_take_one_table(spark, monkeypatch):
    """Clusters of many small performances are found without tables of cells and pairs."""
    names = []
    plain = relops.saved
    monkeypatch.setattr(relops, "saved", lambda df, name: names.append(name) or plain(df, name))
    points = spark.range(2000).select((F.col("id") % 40).alias("perf_id"), F.col("id").alias("index"), (F.rand(3) * 9).alias("x"), (F.rand(4) * 9).alias("y"))
    relops.cluster(points, {"x": 1.0, "y": 1.0}).count()
    assert names == ["clusters"]


def test_a_dense_cell_is_linear(spark):
    points = spark.range(60000).select(F.lit(1).alias("perf_id"), F.col("id").alias("index"), (F.rand(3) * 1.9).alias("x"), (F.rand(4) * 1.9).alias("y"))
    began = time.time()
    out = relops.cluster(points, {"x": 1.0, "y": 1.0}).groupBy("label").count().collect()
    assert [(r["label"], r["count"]) for r in out] == [(0, 60000)] and time.time() - began < 60
    _, pairs = relops.touching_cells(points, {"x": 1.0, "y": 1.0})
    assert pairs.count() <= 6


def test_no_points(spark):
    none = spark.createDataFrame([], "perf_id int, index int, x double, y double")
    assert relops.cluster(none, {"x": 1.0, "y": 1.0}).collect() == []
