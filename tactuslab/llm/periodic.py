"""Runs of words that repeat with a period, and texts without their repetitions.

A run is a stretch of consecutive words whose smallest period q is at most half its length, at least
SHORTEST words long, and can't be made longer with that period. Every word of a run occurs in it at
least twice, so a word that occurs once in a segment of a text can't lie in a run of that segment: such
words split it. In the pieces other words have become rare; they are split again until none changes.
Pieces below SHORTEST words hold no run. This is done for many texts at once.

Surviving segments are scanned by lag: words q apart are equal in a row over at least q words of a run
of period q, so one of the segment's places 0, q, 2q ... lies among these and equals the next one. Places
that do are extended both ways by comparing hashes of growing and shrinking stretches, which takes
m log m comparisons for a segment of m words. Of stretches with the same ends the smallest lag is the
period. What hashes have found is compared word for word; should it differ, the segment is scanned lag by
lag without hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tactuslab.llm.common import mixed

SHORTEST = 12
#: Words whose texts are split together, and pairs of places that are compared together.
WORDS = 1 << 17
PAIRS = 1 << 20
_BASE = 0x9E3779B97F4A7C15

RUNS = ArrayType(StructType([StructField(name, LongType()) for name in ("start", "length", "period")]))


def numbered_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, equal where text and word are, and the place at which each text begins, with the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    codes = np.zeros(starts[-1], np.int64)
    for words, begin, end in zip(texts, starts.tolist(), starts[1:].tolist()):
        first: dict[bytes, int] = {}
        codes[begin:end] = np.fromiter(map(first.setdefault, words, count(begin)), np.int64, end - begin)
    return codes, starts


def segments(codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) that may hold runs: no word occurs only once in its stretch."""
    at = np.arange(len(codes))
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    while len(at):
        key = group * (len(codes) + 1) + codes[at]
        _, inverse, often = np.unique(key, return_inverse=True, return_counts=True)
        stays = often[inverse] > 1
        rest, of = at[stays], group[stays]
        cut = np.flatnonzero((np.diff(rest) != 1) | (np.diff(of) != 0)) + 1
        bounds = np.concatenate([[0], cut, [len(rest)]]) if len(rest) else np.zeros(1, np.int64)
        lengths = np.diff(bounds)
        long = lengths >= SHORTEST
        if stays.all() and long.all():
            return list(zip(rest[bounds[:-1]].tolist(), (rest[bounds[1:] - 1] + 1).tolist()))
        at, group = rest[np.repeat(long, lengths)], np.repeat(np.arange(int(long.sum())), lengths[long])
    return []


def _prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(len(codes) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return total, power


def _extended(total: np.ndarray, power: np.ndarray, a: np.ndarray, lag: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from a on (step 1) or before a (step -1), most at most, equal those lag further, by bisection."""
    low, high = np.zeros_like(a), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        b, e = (a, a + mid) if step > 0 else (a - mid, a)
        same = (total[e] - total[b]) * power[lag] == total[e + lag] - total[b + lag]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def _pairs(pieces: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places and lags to compare, with the begin and end of their segments, some PAIRS at a time."""
    begin, end = (np.array(x, np.int64) for x in zip(*pieces))
    lags = (end - begin) // 2
    upto = np.cumsum(lags)
    done = 0
    while done < upto[-1]:
        # Of segment s the lags 1 to half its length; a lag of q has a place at each q words but the last.
        row = np.arange(done, min(done + PAIRS // 4, int(upto[-1])))
        s = np.searchsorted(upto, row, "right")
        q = row - (upto[s] - lags[s]) + 1
        places = (end[s] - begin[s] - 1) // q
        total = np.cumsum(places)
        keep = max(1, int(np.searchsorted(total, PAIRS, "right")))
        s, q, places = s[:keep], q[:keep], places[:keep]
        done += keep
        k = np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)
        lag, s = np.repeat(q, places), np.repeat(s, places)
        yield begin[s] + k * lag, lag, begin[s], end[s]


def _by_lag(codes: np.ndarray, begin: int, end: int) -> set[tuple[int, int, int]]:
    """Stretches (begin, end, lag) of one segment, lag by lag."""
    found = set()
    for q in range(1, (end - begin) // 2 + 1):
        same = np.zeros(end - begin - q + 2, np.int8)
        same[1:-1] = codes[begin : end - q] == codes[begin + q : end]
        first, last = np.flatnonzero(np.diff(same) > 0), np.flatnonzero(np.diff(same) < 0)
        found |= {(begin + int(a), begin + int(b) + q, q) for a, b in zip(first, last) if b - a + q >= max(SHORTEST, 2 * q)}
    return found


def _is_run(codes: np.ndarray, piece: tuple[int, int], found: tuple[int, int, int]) -> bool:
    (begin, end), (a, b, q) = piece, found
    longer = (a > begin and codes[a - 1] == codes[a - 1 + q]) or (b < end and codes[b] == codes[b - q])
    return not longer and np.array_equal(codes[a : b - q], codes[a + q : b])


def runs(codes: np.ndarray, pieces: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """All runs (begin, end, period) in segments, by begin and then period."""
    if not pieces:
        return []
    total, power = _prefixes(codes)
    found = []
    for a, lag, begin, end in _pairs(pieces):
        hit = codes[a] == codes[a + lag]
        a, lag, begin, end = (x[hit] for x in (a, lag, begin, end))
        # A run of SHORTEST words or more has six equal ones in a row: most hits by chance end sooner.
        ahead = _extended(total, power, a, lag, np.minimum(6, end - a - lag), 1)
        back = _extended(total, power, a, lag, np.minimum(6, a - begin), -1)
        hit = ahead + back >= np.minimum(6, np.maximum(SHORTEST - lag, lag))
        a, lag, begin, end = (x[hit] for x in (a, lag, begin, end))
        first = a - _extended(total, power, a, lag, a - begin, -1)
        last = a + lag + _extended(total, power, a, lag, end - a - lag, 1)
        hit = last - first >= np.maximum(SHORTEST, 2 * lag)
        found.append(np.unique(np.stack([first[hit], last[hit], lag[hit]], axis=1), axis=0))
    smallest: dict[tuple[int, int], int] = {}
    for a, b, q in np.concatenate(found).tolist():
        smallest[a, b] = min(q, smallest.get((a, b), q))
    ends = np.array([e for _, e in pieces])
    out = {(a, b, q) for (a, b), q in smallest.items()}
    wrong = {k for r in out if not _is_run(codes, pieces[k := int(np.searchsorted(ends, r[0], "right"))], r)}
    for k in wrong:
        begin, end = pieces[k]
        smallest = {}
        for a, b, q in _by_lag(codes, begin, end):
            smallest[a, b] = min(q, smallest.get((a, b), q))
        out = {r for r in out if not begin <= r[0] < end} | {(a, b, q) for (a, b), q in smallest.items()}
    return sorted(out, key=lambda r: (r[0], r[2]))


def _texts(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of the texts of a column, some WORDS at a time."""
    group, n = [], 0
    for text in column:
        words = (text.as_py() or "").encode().split()  # at the six ASCII spaces
        group.append(words)
        n += len(words)
        if n >= WORDS:
            yield group
            group, n = [], 0
    if group:
        yield group


def find(texts: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text by word number."""
    codes, starts = numbered_words(texts)
    found = runs(codes, segments(codes, starts))
    of = np.searchsorted(starts, [r[0] for r in found], "right") - 1
    by_text: dict[int, list] = {}
    for k, (a, b, q) in zip(of.tolist(), found):
        by_text.setdefault(k, []).append((a - int(starts[k]), b - a, q))
    return (by_text.get(k, []) for k in range(len(texts)))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words but those that lie behind the first period of any run, joined by one space."""
    if found:
        edge = np.zeros(len(words) + 1, np.int64)
        for a, length, q in found:
            edge[a + q] += 1
            edge[a + length] -= 1
        words = [w for w, out in zip(words, (np.cumsum(edge[:-1]) > 0).tolist()) if not out]
    return b" ".join(words)


def find_runs(documents: DataFrame) -> DataFrame:
    """Add runs (start, length, period of each, by start and then period) and collapsed, the text without repetitions.

    Words are what ASCII spaces separate. A null or empty text has no runs and an empty collapsed text.
    Each row is judged by itself, so repeated rows give repeated results; other columns stay, but those
    named runs or collapsed are replaced. An empty table gives an empty one. A text is held whole in a task.
    """
    rows = documents.drop("runs", "collapsed")
    schema = StructType([*rows.schema.fields, StructField("runs", RUNS), StructField("collapsed", StringType())])
    at = rows.columns.index("text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _texts(batch.column(at)):
                found = list(find(texts))
                made = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in found], kind)
                out = pa.array([collapsed(w, x).decode() for w, x in zip(texts, found)], pa.string())
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, made, out], names=[*part.schema.names, "runs", "collapsed"])

    return rows.mapInArrow(work, schema)


def looped(doc_id: Column, text: Column) -> Column:
    """Texts of every tenth document by crc32 of doc_id with an end that repeats: a test's input for runs.

    With h = crc32 and g = floor(h / 10) word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). A null id has no h: its text stays.
    """
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def end(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.array_join(F.concat(F.slice(w, 1, a), again), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, end(w)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, changed).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Per document the number of its runs, its longest one (ties: smallest start, then period), and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    rows = found.withColumn("_b", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.expr("(1000 * _b.length) div (-_b.period)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
