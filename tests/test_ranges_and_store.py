"""Ranges against counting every point, the store against a dictionary."""

import random

from tactuslab.operators import ranges, store


def _ranges(r):
    rows = []
    for p in range(8):
        for _ in range(r.randint(0, 7)):
            a = r.randint(0, 30)
            rows.append((p, a, a + r.randint(-1, 8)))
    return [*rows, (0, None, 3), (0, 4, None), *rows[:3]]


def test_coverage_and_overlaps(spark):
    for seed in range(3):
        rows = _ranges(random.Random(seed))
        table = spark.createDataFrame(rows, "perf_id int, start int, end int")
        depth = {(p, x): sum(a is not None and b is not None and a <= x < b for q, a, b in rows if q == p) for p in range(8) for x in range(-1, 45)}
        got = {(r["perf_id"], x) for r in ranges.coverage(table).collect() for x in range(r["start"], r["end"])}
        assert got == {k for k, n in depth.items() if n}
        islands = ranges.coverage(table).collect()
        assert sum(r["n_ranges"] for r in islands) == sum(a is not None and b is not None and a < b for _, a, b in rows)
        assert all((r["perf_id"], r["end"]) not in got for r in islands)
        deep = {(r["perf_id"], x): r["depth"] for r in ranges.overlaps(table).collect() for x in range(r["start"], r["end"])}
        assert deep == {k: n for k, n in depth.items() if n > 1}


def test_members_with_both_ends(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 25, 30), (2, 5, 6), (2, 9, 9)]
    points = [(p, d, f"{p}-{d}") for p in (1, 2, 3) for d in range(0, 35, 5)] + [(1, None, "none")]
    got = ranges.members(spark.createDataFrame(points, "perf_id int, date int, name string"), spark.createDataFrame(rows, "perf_id int, start int, end int")).collect()
    want = [(n, a, b) for p, d, n in points if d is not None for q, a, b in rows if q == p and a < b and a <= d <= b]
    assert sorted((r["name"], r["range_start"], r["range_end"]) for r in got) == sorted(want)


def test_uncovered_instructions_begin_anew(spark):
    r = random.Random(5)
    for _ in range(3):
        spans = _ranges(r)
        have = [(p, float(d), f"{p}-{d}") for p in range(8) for d in r.sample(range(40), 6)]
        want = []
        for p in range(8):
            inside = {x for q, a, b in spans if q == p and a is not None and b is not None for x in range(a, b)}
            own = sorted(x for x in have if x[0] == p)
            want += [(*x, False) for x in own if x[1] not in inside]
            for end in sorted({x + 1 for x in inside if x + 1 not in inside}):
                begin = end - 1
                while begin - 1 in inside:
                    begin -= 1
                gone = [x for x in own if begin <= x[1] < end]
                if gone and not any(x[1] == end for x in own):
                    want.append((p, float(end), gone[-1][2], True))
        got = ranges.uncovered(spark.createDataFrame(have, "perf_id int, date double, name string"), spark.createDataFrame(spans, "perf_id int, start int, end int")).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_store(spark):
    r = random.Random(6)
    kind = "perf_id int, scope int, date double, id string, bpm double"
    row = lambda k: (r.randint(0, 3), r.choice([None, 0, 1]), float(r.randint(0, 6)), f"i{k}", float(k))
    have = list({x[:3]: x for x in (row(k) for k in range(60))}.values())
    new = [row(100 + k) for k in range(40)]
    want = {x[:3]: x for x in have} | {x[:3]: x for x in sorted(new, key=lambda x: x[4])}
    df = lambda rows: spark.createDataFrame(rows, kind)
    out = store.put(df(have), df(new), ["bpm"])
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want.values()))
    assert sorted(map(repr, map(tuple, store.put(df(have), df([])).collect()))) == sorted(map(repr, have))
    assert len(store.put(df([]), df(new)).collect()) == len({x[:3] for x in new})
    gone = {x[:3] for x in new[:15]}
    left = store.remove(out, df(new[:15]).select("perf_id", "scope", "date")).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(repr(x) for k, x in want.items() if k not in gone)
    points = [(p, s, d + 0.5) for p in range(4) for s in (None, 0, 1) for d in range(-1, 7)]
    got = store.in_force(spark.createDataFrame(points, "perf_id int, scope int, date double"), out, ["id"]).collect()
    last = lambda p, s, d: max((x for k, x in want.items() if k[:2] == (p, s) and k[2] <= d), key=lambda x: x[2], default=(None,) * 5)[3]
    assert {(x["perf_id"], x["scope"], x["date"]): x["id"] for x in got} == {k: last(*k) for k in points}
