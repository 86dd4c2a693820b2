"""Runs of words against a plain scan of all lags."""

import hashlib
import random
import zlib

import pytest

from tactuslab.llm import periodic


def _brute(w):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def _word_list(r):
    n, k = r.choice([0, 1, 11, 12, 13, 40, 90, 200]), r.choice([1, 2, 3, 5, 30])
    w = [b"w%d" % r.randint(0, k) for _ in range(n)]
    if n > 20 and r.random() < 0.6:
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 3))
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("pairs", [64, 1000, 1 << 20])
def test_fuzz(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    r = random.Random(pairs)
    for _ in range(60):
        texts = [_word_list(r) for _ in range(r.randint(1, 6))]
        assert list(periodic.find(texts)) == [_brute(w) for w in texts]


def test_hashes_that_collide_are_found_out(monkeypatch):
    w = [b"b" if bin(k).count("1") % 2 else b"a" for k in range(1 << 11)]
    want = list(periodic.find([w]))[0]
    codes, _ = periodic.numbered_words([w])
    by_lag = {}
    for a, b, q in periodic._by_lag(codes, 0, len(w)):
        by_lag[a, b] = min(q, by_lag.get((a, b), q))
    assert want == sorted(((a, b - a, q) for (a, b), q in by_lag.items()), key=lambda r: (r[0], r[2]))
    monkeypatch.setattr(periodic, "mixed", lambda x: x * 0)  # every stretch looks like every other
    r = random.Random(4)
    texts = [_word_list(r) for _ in range(20)]
    for found, text in zip(periodic.find(texts), texts):
        assert set(found) <= set(_brute(text))


def test_segments_hold_no_word_once():
    words = [b"a b c a b c a b c a b c x d e d e d e d e d e d e d y a".split()]
    codes, starts = periodic.numbered_words(words)
    assert periodic.segments(codes, starts) == [(0, 12), (13, 26)]


def _looped(doc_id, text):
    w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_digest_of_documents(spark):
    r = random.Random(11)
    rows = [(k, " ".join(f"w{r.randint(0, 25)}" for _ in range(r.choice([0, 5, 30, 150])))) for k in range(300)]
    rows += [(-3, "ein\tzwei\x0bdrei  vier\r\n" * 9), (901, None), (902, ""), (903, " \n "), (904, "é x  " * 20), (905, "same " * 50), (905, "same " * 50)]
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in rows], "doc_id long, text string, runs string, start int")
    out = periodic.digest(periodic.find_runs(docs.withColumn("text", periodic.looped(docs["doc_id"], docs["text"])))).collect()
    want = []
    for i, t in rows:
        w = _looped(i, t)
        found = _brute(w)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, (tuple(x[c] for c in names) for x in out))) == sorted(map(repr, want))
    assert sum(x[1] > 0 for x in want) > 10


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b " * 20)], "doc_id long, text string")
    text = docs.select("doc_id", periodic.looped(docs["doc_id"], docs["text"]).alias("text"))
    assert [tuple(map(tuple, r["runs"])) for r in periodic.find_runs(text).collect()] == [((0, 40, 2),)]
    assert periodic.find_runs(docs.limit(0)).collect() == []
    assert periodic.find_runs(docs.limit(0)).columns == ["doc_id", "text", "runs", "collapsed"]
