"""How near the estimates of fingerprints come to the true values, and what short texts have."""

import random

import numpy as np
from pyspark.sql import functions as F

from tactuslab.llm import fingerprint

DOCS = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_estimates_against_true_similarity(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randint(0, 5000)}"
    docs, last = [], [word() for _ in range(1500)]
    for k in range(60):
        last = [w if rng.random() > 0.02 else word() for w in last] if k % 6 else [word() for _ in range(1500)]
        docs.append((k, " ".join(last)))
    out = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(spark.createDataFrame(docs, DOCS)).collect()}
    errors = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = shingles(t), shingles(edited), shingles(nxt)
        errors += [out[i]["near_edited"] - len(a & b) / len(a | b), out[i]["near_next"] - len(a & c) / len(a | c)]
    assert np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_unions_and_short_texts(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = spark.createDataFrame([(1, a), (2, b), (3, a.upper()), (4, ""), (5, None), (6, " ".join(f"x{k}" for k in range(200)))], DOCS)
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(rows).select("*", fingerprint.written(F.col("sketch"), F.col("fallback")).alias("f"), fingerprint.read(fingerprint.written(F.col("sketch"), F.col("fallback"))).alias("back")).collect()}
    assert all(r["back"] == r["sketch"] and all(h < fingerprint.TOP for h in r["sketch"]) for r in out.values())
    assert (out[1]["f"], out[4]["f"], out[5]["f"]) == (out[3]["f"], "", "") and out[1]["f"] != out[2]["f"] and len(out[1]["f"]) == len(out[2]["f"]) == 16
    both = fingerprint.fingerprints(spark.createDataFrame([(1, a + " " + b), (2, a), (3, b)], DOCS)).collect()
    parts = {h for r in both[1:] for h in r["sketch"]}
    assert parts <= set(both[0]["sketch"])
    pair = spark.createDataFrame([([], 5, [], 5), ([], 5, [], 6), ([], None, [], None), ([], 5, [], None), ([], 5, [1], None)], "a array<long>, x long, b array<long>, y long")
    assert [r[0] for r in pair.select(fingerprint.likeness(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).collect()] == [1, 0, 1, 0, 0]
    assert {r[0] for r in pair.select(fingerprint.containment(F.col("a"), F.col("b"))).collect()} == {None}


def test_places_among_bounds(spark):
    for n in (0, 1, 2, 7, 50):
        bounds = [3 * k for k in range(n)]
        got = spark.range(-5, 160).select("id", fingerprint._place(bounds, F.col("id")).alias("k")).collect()
        assert all(r["k"] == sum(b < r["id"] for b in bounds) for r in got)
