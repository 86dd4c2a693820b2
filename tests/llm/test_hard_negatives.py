"""Hard negatives against scoring every row with every anchor."""

import math
import random

import numpy as np

from tactuslab.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int, id string, shard int, windows string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], SCHEMA)


def _brute(rows):
    part = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, v, label) in enumerate(part):
        if i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, o == label) for n, (j, w, o) in enumerate(part) if n != k]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, j, _ in [s for s in scored if s[2]][:5]:
            hits = [s for s in scored if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(i, j, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(hits, 1)]
    return sorted(out)


def _mined(table, **more):
    return sorted(map(tuple, hard.mine(table, **more).collect()))


def test_random_ties_nulls_and_repeats(spark):
    r = random.Random(5)
    for seed in range(3):
        rows = [(r.randrange(400) * (25 if k % 3 == 0 else 1), [r.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(r.choice([3, 4]))], r.randrange(3)) for k in range(160)]
        rows += [(50, None, 1), (100, [1.0, None, 2.0], 1), (150, [1.0, math.nan], 1), (200, [math.inf], 1), (None, [1.0, 1.0], 1), (250, [1.0], None), (300, [], 1), (350, [0.0, 0.0, 0.0], 2)]
        rows += rows[:20]
        assert _mined(_table(spark, rows), shard_rows=40) == _brute(rows)


def test_empty_and_single(spark):
    assert _mined(_table(spark, [])) == []
    assert _mined(_table(spark, [(50, [1.0, 2.0], 1)])) == []
    assert _mined(_table(spark, [(50, None, 1)])) == []


def test_large_numbers_do_not_fail(spark):
    rows = [(k, [1e300 if k == 3 else float(k), 1.0, -2.5], k % 2) for k in range(60)]
    assert len(_mined(_table(spark, rows))) > 0


def test_equal_vectors_in_one_cell(spark):
    rows = [(k, [1.0, 0.0, 0.5, 0.5], k % 4) for k in range(300)] + [(1000 + k, [0.7, 0.0, 0.5, 0.3], 5) for k in range(5)]
    assert _mined(_table(spark, rows), shard_rows=64) == _brute(rows)


def test_clusters_are_not_all_visited():
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16)) * 300
    v = np.rint(centres[r.integers(0, 40, 20000)] + r.normal(size=(20000, 16)) * 5)
    books = hard.Codebooks(16, hard._codewords(v[:, :8], 32), hard._codewords(v[:, 8:], 32))
    ids, labels = np.arange(20000), r.integers(0, 5, 20000)
    shard = hard.Shard(books, ids, ids, labels, v)
    seen = []
    for k in range(0, 2000, 50):
        found, n = hard._search(shard, v[k], labels[k], k, None)
        score = v @ v[k]
        mine = np.flatnonzero((labels == labels[k]) & (ids != k))
        best = mine[np.lexsort((mine, -score[mine]))[:5]]
        assert [f[2] for f in found] == best.tolist()
        seen.append(n)
    assert np.mean(seen) < 0.15 * 20000


def test_cells_come_by_falling_bounds_and_hold():
    r = np.random.default_rng(2)
    v = np.rint(r.normal(size=(3000, 6)) * 100)
    books = hard.Codebooks(6, hard._codewords(v[:, :3], 8), hard._codewords(v[:, 3:], 8))
    shard = hard.Shard(books, np.arange(3000), np.arange(3000), np.zeros(3000, np.int64), v)
    for q in v[:5]:
        cells = list(shard.walk(q))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
        assert sum(c[2] - c[1] for c in cells) == 3000
        assert all((shard.v[a:b] @ q).max() <= bound + 1e-6 for bound, a, b in cells)
