"""Mixing against resharing step by step, and against its rules."""

import random
import re

import duckdb
import pytest

from tactuslab.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, _k string, target string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "k", "t") for i, t, s in rows], SCHEMA)


def _targets(sizes):
    """Sources' targets by resharing what is above the limit until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        rest = total - sum(out.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over


def _random(r, n, sources):
    return [(k, " ".join("w" for _ in range(r.choice([0, 1, 2, 5, 40, 300]))), r.choice(sources)) for k in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["a", None], ["b", "a", "ä", "Z", None, ""], [f"s{k}" for k in range(25)]])
def test_targets_and_copies(spark, sources):
    r = random.Random(len(sources))
    rows = _random(r, 300, sources) + [(900, "  ", "only spaces"), (901, None, "only null"), (None, "a\tb\nc\x0bd", "a"), (5, "x y", "a"), (5, "x y", "a")]
    out = mixing.mix(_docs(spark, rows)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = _targets(sizes)
    assert sorted((repr(i), words(t)) for i, t, _ in rows) == sorted((repr(x["doc_id"]), x["size"]) for x in out)
    taken = {}
    for x in out:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
        ratio = want[x["source"]] / sizes[x["source"]] if sizes[x["source"]] else 0
        assert int(ratio + 1e-9) <= x["copies"] <= min(2, -int(-ratio // 1)) if ratio else x["copies"] == 0
        taken[x["source"]] = taken.get(x["source"], 0) + x["copies"] * x["size"]
    longest = max(words(t) for _, t, _ in rows)
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    again = mixing.mix(_docs(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_empty_tables(spark):
    assert mixing.mix(_docs(spark, [])).collect() == []
    out = mixing.mix(_docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert {(x["copies"], x["target"], x["source_size"]) for x in out} == {(0, 0.0, 0)}


def test_sql_gives_the_same(spark):
    rows = _random(random.Random(2), 400, ["a", "b", "c", None])
    docs = _docs(spark, rows)
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    want = duckdb.sql(mixing.ORACLE_SQL).fetchall()
    got = mixing.digest(mixing.mix(docs)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_documents_are_emitted_as_often(spark):
    docs = _docs(spark, [(k, "w " * (k % 9), "ab"[k % 2]) for k in range(60)])
    mixed = mixing.mix(docs)
    out = mixing.emitted(docs, mixed)
    assert out.columns == docs.columns
    often = {r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]}
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == often
