"""Hard negatives by an inverted multi-index.

A vector is cut into two halves, each with a codebook of its own; a pair of codewords is a cell, and the
cells' lists hold all vectors. With the largest distance of a half from its codeword (its radius) an
anchor's score with any vector of a cell (i, j) is at most the sum over both halves of
anchor . codeword + |anchor| * radius. A heap walks the cells by that sum, best first, from the two sorted
lists of halves; a search stops as soon as the next cell's bound lies below what it still needs, so what
it returns is exact. Positives stop at the last of the best WIDTH scores; negatives at the third score of
every window, or at its lower end while it has fewer.

The index is dealt out in shards of SHARD_ROWS rows, each with lists and radii of its own. Rows go to shards
by what they hold and by their number, so that a hot cell, label or vector lies in all of them. A task
holds one shard and streams the anchors past it, which come behind the shard's rows in order; no anchor
table, shard or group is held whole anywhere. What shards found is cut to the best few per anchor by
a window of at most a few rows for each shard.

Codebooks are fitted on SAMPLE rows at most, chosen by a hash of their id; every row is indexed, and
radii cover every row, so the sample decides only about speed. How many cells a search visits is up to the
data: where vectors have no clusters, bounds with radii exclude nothing and all cells are visited.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.llm.common import fitted, hash_reach, saved

#: Rows of a shard, and rows that codebooks are fitted on, at most.
SHARD_ROWS = 1 << 19
SAMPLE = 20_000
#: Rows that a list should hold, and codewords of a half, at most.
LIST_ROWS = 32
CODEWORDS = 64
#: Rows that a search looks at before it asks again whether it may stop.
STEP = 512
FIT_ROUNDS = 8

ANCHOR_EVERY = 50
RELABEL_EVERY = 7
SCALE = 256
WIDTH = 5
KEPT = 3
LOW, HIGH = 50, 95

#: Scores beyond this count as so much: a hundred times it still is a long.
FARTHEST = 1 << 56


def vectors(embeddings: DataFrame) -> DataFrame:
    """rid, id, label and v (whole numbers as doubles) of the rows that take part; the table is written, which fixes rid.

    Rows with a null id, label or vector, or a component that is null or not finite take no part. Rows
    that repeat count each by itself, as do rows that share an id.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select("vec_id", "label", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % 10).otherwise(label)
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.transform("v", lambda x: F.rint(F.floor(x * SCALE).cast("double"))).alias("v"))
    return saved(rows, "vectors")


class Codebooks:
    """Codewords of both halves, and how many components vectors have."""

    def __init__(self, width: int, first: np.ndarray, second: np.ndarray) -> None:
        self.width, self.half, self.words = width, width // 2, (first, second)

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, : self.half], v[:, self.half :]

    def cells(self, v: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half the nearest codeword of each row, and the distance to it."""
        places, reach = [], []
        for h, words in zip(self.halves(v), self.words):
            near = np.argmin((words**2).sum(1) - 2 * h @ words.T, axis=1)
            places.append(near)
            reach.append(np.sqrt(((h - words[near]) ** 2).sum(1)))
        return places, reach


def _codewords(x: np.ndarray, k: int) -> np.ndarray:
    """k centres of the rows of x, or as many as differ, from evenly spaced rows on."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    words = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(FIT_ROUNDS):
        near = np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of width; missing components are 0."""
    values = column.to_pylist()
    out = np.zeros((len(values), width))
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    return out


def fit(rows: DataFrame, n_rows: int, width: int, shards: int) -> Codebooks:
    """Codebooks from a bounded sample, in one task."""
    k = int(min(CODEWORDS, max(2, (n_rows / shards / LIST_ROWS) ** 0.5)))
    sample = rows.where(F.xxhash64("id", "rid") <= hash_reach(min(1.0, 0.9 * SAMPLE / max(1, n_rows)))).limit(SAMPLE)

    def books(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        parts = [_matrix(b.column(1), width) for b in batches]
        x = np.concatenate(parts) if parts else np.zeros((1, width))
        return _codewords(x[:, : width // 2], k), _codewords(x[:, width // 2 :], k)

    return Codebooks(width, *fitted(sample.select("rid", "v"), ["rid"], books))


class Shard:
    """Rows in lists by cell and label, and what bounds take of them."""

    def __init__(self, books: Codebooks, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        self.books = books
        (a, b), reach = books.cells(v.astype(float))
        self.k = tuple(len(w) for w in books.words)
        cell = a * self.k[1] + b
        order = np.lexsort((labels, cell))
        self.ids, self.rids, self.labels, self.v = ids[order], rids[order], labels[order], v[order]
        self.starts = np.searchsorted(cell[order], np.arange(self.k[0] * self.k[1] + 1))
        self.longest = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
        self.radii = []
        for near, far, k in zip((a, b), reach, self.k):
            radius = np.full(k, -np.inf)  # of a codeword without rows: its cells bound nothing
            np.maximum.at(radius, near, far)
            self.radii.append(radius)

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Bound, begin and end of the lists that have rows, best bound first."""
        sides = []
        for h, words, radius in zip(self.books.halves(q[None, :].astype(float)), self.books.words, self.radii):
            length = float(np.sqrt((h**2).sum()))
            bound = (words @ h[0]) + length * radius if length else np.where(np.isinf(radius), -np.inf, 0.0)
            best = np.argsort(-bound, kind="stable")
            sides.append((bound[best].tolist(), best.tolist()))
        (one, first), (two, second) = sides
        heap = [(-(one[0] + two[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound == np.inf:
                return
            if j + 1 < len(two):
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))
            cell = first[i] * self.k[1] + second[j]
            begin, end = int(self.starts[cell]), int(self.starts[cell + 1])
            if begin < end:
                yield -bound, begin, end

    def search(self, q: np.ndarray, needed: Callable[[], float], look: Callable[[np.ndarray, np.ndarray], None]) -> int:
        """Show look the places and scores of lists until no other can hold what is needed; how many rows it saw."""
        lists, n, seen = [], 0, 0
        slack = 1e-9 * (1 + float(np.sqrt((q.astype(float) ** 2).sum())) * self.longest)
        for bound, begin, end in self.walk(q):
            if bound + slack < needed():
                break
            lists.append((begin, end))
            n += end - begin
            if n >= STEP:
                self._show(q, lists, look)
                seen, lists, n = seen + n, [], 0
        if lists:
            self._show(q, lists, look)
        return seen + n

    def _show(self, q: np.ndarray, lists: list[tuple[int, int]], look: Callable) -> None:
        places = np.concatenate([np.arange(a, b) for a, b in lists])
        look(places, np.concatenate([self.v[a:b] @ q for a, b in lists]))


def _best(score: np.ndarray, ids: np.ndarray, rids: np.ndarray, most: int) -> np.ndarray:
    """Places of the best scores, ties by id."""
    if len(score) > 4 * most:
        floor = np.partition(score, len(score) - most)[len(score) - most]
        some = np.flatnonzero(score >= floor)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((rids[some], ids[some], -score[some]))[:most]]


class _Top:
    """The best few of what a search has seen in a window of scores."""

    def __init__(self, most: int, low: float, high: float) -> None:
        self.most, self.low, self.high = most, low, high
        self.score, self.id, self.rid = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def needed(self) -> float:
        if self.high < self.low:
            return np.inf
        return max(self.low, float(self.score[-1])) if len(self.score) == self.most else self.low

    def add(self, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        hit = (score >= self.needed()) & (score <= self.high)
        if hit.any():
            score, ids, rids = (np.concatenate([a, b[hit]]) for a, b in zip((self.score, self.id, self.rid), (score, ids, rids)))
            best = _best(score, ids, rids, self.most)
            self.score, self.id, self.rid = score[best], ids[best], rids[best]


def _search(shard: Shard, q: np.ndarray, label: int, rid: int, windows: list[tuple[int, int]] | None) -> tuple[list[tuple], int]:
    """Found (window, score, id) and rows seen: the best WIDTH others of the label, or without it the best KEPT of each window."""
    tops = [_Top(WIDTH, -np.inf, np.inf)] if windows is None else [_Top(KEPT, lo, hi) for lo, hi in windows]

    def look(places: np.ndarray, score: np.ndarray) -> None:
        mine = (shard.labels[places] == label) & (shard.rids[places] != rid) if windows is None else shard.labels[places] != label
        some = places[mine]
        for top in tops:
            top.add(score[mine], shard.ids[some], shard.rids[some])

    seen = shard.search(q, lambda: min(t.needed() for t in tops), look)
    whole = lambda s: int(min(max(s, -FARTHEST), FARTHEST))
    return [(k, whole(s), int(i), int(r)) for k, t in enumerate(tops) for s, i, r in zip(t.score, t.id, t.rid)], seen


def _searched(index: DataFrame, anchors: DataFrame, books: Codebooks, shards: int, number: str, windows: bool) -> DataFrame:
    """What each shard finds for each anchor: anchor, window, score, id, rid, and seen, the rows it looked at.

    index and anchors have shard, kind (0 and 1), rid, id, label and v, anchors with windows (array of structs low and high) beside.
    """
    spans = "array<struct<low:bigint,high:bigint>>"
    both = index.withColumn("windows", F.lit(None).cast(spans)).unionByName(anchors if windows else anchors.withColumn("windows", F.lit(None).cast(spans)))
    rows = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    names = ["anchor", "window", "score", "id", "rid", "seen"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for batch in batches:
            place, kind = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
            out = []
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                rids, ids, labels = (part.column(k).to_numpy() for k in (2, 3, 4))
                if place[begin] != at:
                    at, parts, shard = place[begin], [], None
                v = np.frombuffer(b"".join(part.column(5).to_pylist()), number).reshape(len(part), books.width)
                if kind[begin] == 0:
                    parts.append((ids, rids, labels, v))
                    continue
                if shard is None:
                    if not parts:
                        continue
                    shard, parts = Shard(books, *(np.concatenate(x) for x in zip(*parts))), []
                wins = part.column(6).to_pylist() if windows else [None] * len(part)
                for q, rid, label, w in zip(v, rids.tolist(), labels.tolist(), wins):
                    found, seen = _search(shard, q, label, rid, None if w is None else [(x["low"], x["high"]) for x in w])
                    out += [(rid, *f, seen) for f in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    return rows.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def _packed(rows: DataFrame, width: int, number: str) -> DataFrame:
    """rows (rid, id, label, v) with v as bytes of width numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(3), width)
            data = m.astype(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in data], pa.binary())], names=["rid", "id", "label", "v"])

    return rows.select("rid", "id", "label", "v").mapInArrow(work, "rid long, id long, label long, v binary")


def mine(embeddings: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each anchor (vec_id divisible by ANCHOR_EVERY) and each of its first WIDTH positives the first KEPT negatives.

    embeddings has vec_id, label and embedding; other columns aren't read. Columns: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Vectors of different lengths count as
    filled up with zeros, and a component's whole number is clipped to a long. Scores are exact where the
    longest vector's square is below 2**53, beyond that rounded as doubles are, and clipped to FARTHEST. Anchors or
    positives without negatives give no row; an empty table gives an empty one. Of rows equal in score and id
    any may stand for another.
    """
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n_rows, width, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    width = max(2, width or 0)
    number = "<f4" if (longest or 0) < 2.0**24 else "<f8"
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // shard_rows))
    books = fit(rows, n_rows, width, shards)
    index = saved(_packed(rows, width, number).withColumn("shard", F.pmod(F.xxhash64("rid", "id"), F.lit(shards)).cast("int")), "index")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    columns = ["shard", "kind", "rid", "id", "label", "v"]
    form = lambda df, shard, kind: df.withColumn("shard", shard).withColumn("kind", F.lit(kind))
    listed = form(index, F.col("shard"), 0).select(*columns)
    own = index.where(F.col("id") % ANCHOR_EVERY == 0).drop("shard")
    found = _searched(listed, form(own, everywhere, 1).select(*columns), books, shards, number, False)
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "rid"))
    positives = saved(found.withColumn("place", first).where(F.col("place") <= WIDTH).select("anchor", "place", "score", "id"), "positives")
    low, high = F.expr(f"({LOW} * score + 99) div 100"), F.expr(f"({HIGH} * score) div 100")  # below 0 no score is in between
    spans = positives.where("score >= 0").withColumn("span", F.struct("place", low.alias("low"), high.alias("high")))
    windows = spans.groupBy(F.col("anchor").alias("rid")).agg(F.array_sort(F.collect_list("span")).alias("spans"))  # WIDTH at most
    asking = own.join(windows, "rid").withColumn("windows", F.transform("spans", lambda s: F.struct(s.low.alias("low"), s.high.alias("high")))).drop("spans")
    found = _searched(listed, form(asking, everywhere, 1).select(*columns, "windows"), books, shards, number, True)
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "rid"))
    negatives = found.withColumn("rank", rank).where(F.col("rank") <= KEPT)
    order = F.row_number().over(Window.partitionBy("anchor").orderBy("place")) - 1
    of = positives.where("score >= 0").withColumn("window", order.cast("long")).select("anchor", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = own.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    out = negatives.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "window"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    """The same rows by scoring each anchor with each row."""
    return f"""WITH part AS (SELECT vec_id AS id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v, row_number() OVER () AS rid FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.rid AS arid, a.id AS anchor_id, b.id, b.rid, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM part a JOIN part b ON a.rid <> b.rid WHERE a.id % {ANCHOR_EVERY} = 0),
positive AS (SELECT arid, anchor_id, id, score, row_number() OVER (PARTITION BY arid ORDER BY score DESC, id, rid) AS place FROM scored WHERE alike QUALIFY place <= {WIDTH}),
ranked AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.arid, p.place ORDER BY s.score DESC, s.id, s.rid)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positive p JOIN scored s ON p.arid = s.arid AND NOT s.alike AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {KEPT}"""
