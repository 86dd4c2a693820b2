"""Decontamination, near duplicates, line dedup and fingerprints against brute force on small fixtures."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tactuslab.llm import decontaminate, fingerprint, line_dedup, near_dedup
from tactuslab.llm.components import components

LONG = "w " * 60_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind).repartition(3)


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items, window=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w = word(text)
    hit, found = set(), set()
    for ident, item in items:
        x = word(item)
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for a in range(len(w) - n + 1):
                if w[a : a + n] == x[k : k + n]:
                    hit.update(range(a, a + n))
                    found.add(ident)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("block_chars", [1_000_000, 120])
def test_contamination(spark, block_chars):
    rng = random.Random(1)
    letters = ["a", "b", "É", "c1", "D"]
    sentence = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(k, sentence(rng.choice([3, 7, 10, 13, 25]))) for k in range(12)] + [(12, None), (13, ""), (14, "..."), (None, "only this"), (15, "x"), (0, sentence(12))]
    docs = [(k, sentence(40) + ". " + (rng.choice(items)[1] or "") + "!" + sentence(9)) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "Only THIS, x"), (103, "only"), (104, LONG), (105, "x"), (105, "x"), (None, "only this")]
    d = table(spark, docs).withColumn("n_words", F.lit("clash"))
    b = table(spark, items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_contamination(d, b, block_chars=block_chars)).collect()
    expected = sorted(repr((i, *brute_hits(t, items))) for i, t in docs)
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got) == expected
    assert all(r["items_sha256"] == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() and r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_contamination_of_empty_tables(spark):
    d, b = table(spark, [(1, "a b")]), table(spark, [], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.digest(decontaminate.find_contamination(d, b)).select("n_words", "n_hit", "n_items").collect()] == [(2, 0, 0)]
    assert decontaminate.find_contamination(d.limit(0), table(spark, [(1, "a")], "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- near duplicates


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = {i: i for i, _ in rows}
    moved = True
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            x, y = rows[a][0], rows[b][0]
            m = min(label[x], label[y])
            moved |= (label[x], label[y]) != (m, m)
            label[x] = label[y] = m
    return {i: (len(s), label[i]) for (i, _), s in zip(rows, sets, strict=True)}


def test_near_duplicates(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (120, 120, 70, 40, 8)]
    passage = [rng.choice(vocabulary) for _ in range(50)]

    def edited(words, share):
        return [rng.choice(vocabulary) + "x" if rng.random() < share else w for w in words]

    rows = [(None, " ".join(edited(base[k % 5], rng.choice([0, 0.005, 0.02, 0.05, 0.1])))) for k in range(110)]
    rows += [(None, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([3, 10, 40]))])) for _ in range(40)]
    rows += [(None, t) for t in (None, "", "  \n", "one", "ONE", "one two", "a b c d e", "A b c d e", LONG, LONG + "z")]
    ids = rng.sample(range(10_000), len(rows))
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]
    d = table(spark, rows + rows[:3]).withColumn("component_id", F.lit("clash"))
    out = near_dedup.near_duplicates(d).collect()
    assert len(out) == len(rows) + 3
    expected = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert len({c for _, c in expected.values()}) < len(rows) - 60


def test_near_duplicates_of_null_ids_and_nothing(spark):
    text = "a b c d e f g"
    out = near_dedup.near_duplicates(table(spark, [(5, text), (None, text), (None, "p q r s t"), (6, None)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == [("5", "5", True), ("6", "6", True), ("None", "5", False), ("None", "None", True)]
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_ids_with_two_texts(spark):
    a, b = ("a b c d e f g h", "p q r s t u v w")
    out = near_dedup.near_duplicates(table(spark, [(3, "x " + a + " " + a), (5, a), (5, b), (7, b), (9, "alone here")])).collect()
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in out}
    assert {c for (i, _), c in got.items() if i in (5, 7)} == {5} and got[9, 1] == 9


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (3, 2)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 130)}


# ---------------------------------------------------------------- lines


def brute_lines(docs, min_words):
    """Every run with an earlier equal run and enough words, by trying all runs."""
    seq = []
    for i, t in docs:
        seq.append([(k, x) for k, x in enumerate(t.split("\n")) if x.split(" ") and x.strip(" \t\r\x0b\x0c")])
    first, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(seq):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                first.setdefault(tuple(x for _, x in lines[a:b]), (d, a))
    for d, lines in enumerate(seq):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(len(x.split()) for x in run) >= min_words and first[run] != (d, a):
                    gone[d].update(k for k, _ in lines[a:b])
    return gone


def test_lines(spark):
    rng = random.Random(3)
    lines = ["a", "b b", "c c c", "d", "e e", "", "  ", "long " * 7]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for k in range(30)]
    docs += [(50, ""), (51, "\n"), (52, docs[3][1]), (53, "u1\nu2\nu3"), (54, "long " * 7 + "\n" + "long " * 7)]
    gone = brute_lines(docs, 6)
    d = table(spark, docs + [(60, None)]).withColumn("deleted", F.lit("clash"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(d, 6).collect()}
    assert len(got) == len(docs) + 1 and got[60]["text"] is None and got[60]["n_lines"] == 0
    for (i, t), g in zip(docs, gone, strict=True):
        assert (i, got[i]["deleted"]) == (i, sorted(g))
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)


def test_lines_of_copies_null_ids_and_nothing(spark):
    long = "\n".join(f"line {k} of a text" for k in range(300))
    out = line_dedup.dedup_lines(table(spark, [(2, long), (None, long), (2, long), (3, "x\n" + long)])).collect()
    assert sorted((str(r["doc_id"]), r["text"][:1]) for r in out) == [("2", ""), ("2", ""), ("3", "x"), ("None", "l")]
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(spark):
    rng = random.Random(4)
    docs = [(k * 3, " ".join(rng.choice(["é", "zwei", "Drei", "vier\n", "fünf"]) + str(rng.randint(0, 30)) for _ in range(rng.choice([0, 1, 4, 5, 60, 300])))) for k in range(50)]
    docs += [(500, None), (501, LONG)]
    out = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(table(spark, docs).withColumn("sketch", F.lit("clash"))).collect()}
    assert len(out) == len(docs)
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (out[i]["n_chars"], out[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = ({x[j : j + 16] for j in range(0, len(x), 16)} for x in (out[i]["fingerprint"], out[i]["edited_fingerprint"]))
        assert out[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert bool(a) == bool(t.split())
    far = [r for r in out.values() if r["n_chars"] > 1000 and r["doc_id"] != 501]
    assert far and all(r["near_edited"] > 0.1 > r["near_next"] for r in far)


def test_fingerprints_merge_and_contain(spark):
    part, whole = " ".join(f"a{k}" for k in range(400)), " ".join(f"a{k}" for k in range(4000))
    d = table(spark, [(1, part), (2, whole), (3, part.upper().replace(" ", "\n"))])
    s = {r["doc_id"]: r["sketch"] for r in fingerprint.fingerprints(d).collect()}
    assert s[1] == s[3] and set(s[1]) <= set(s[2]) and len(s[2]) == pytest.approx(4000 / 8, rel=0.2)
    one = fingerprint.fingerprints(d).where("doc_id = 1").select("sketch", fingerprint.read(fingerprint.written(F.col("sketch"))).alias("back"), fingerprint.containment(F.col("sketch"), F.col("sketch")).alias("c"), fingerprint.merged(F.col("sketch"), F.col("sketch")).alias("m")).collect()[0]
    assert one["back"] == one["sketch"] == one["m"] and one["c"] == 1


def test_neighbours_of_equal_and_null_ids(spark):
    rows = [(None, "n"), (1, "b"), (1, "a"), (2, "c"), (2, "c")]
    for buckets in (1, 3):
        out = fingerprint.with_next(table(spark, rows), ["text"], buckets).collect()
        assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in out) == [("1", "a", "b"), ("1", "b", "c"), ("2", "c", "c"), ("2", "c", "n"), ("None", "n", "a")]
    assert fingerprint.edited_fingerprints(table(spark, [])).count() == 0
    assert fingerprint.edited_fingerprints(table(spark, [(1, "ab")])).collect()[0]["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()
