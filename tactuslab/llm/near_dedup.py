"""MinHash near-dedup: bottom-k sketches from one hash function.

Documents with equal sets of shingles are one class, named by its smallest doc_id. Of each class the
K smallest shingle hashes are retained. Two sets with a similarity of 0.75 share at least NEED of
the K smallest hashes of their union but for a chance of about one in a million, so they also share
one of the K - NEED + 1 rarest retained values of either; inverted lists of these values alone
generate the pairs, and values that many unrelated documents share are not among them. A pair has to
pass the estimate from the sketch of its union, and then exact Jaccard on the full sets.

A short list gives all its pairs. The members of longer ones are joined exactly instead: their full
sets, ordered by rarity among these members, are prefix-filtered with bounds on position and size. Of
two linked sets the smaller has one of its n - 6n/7 + 1 rarest shingles among the n - 3n/4 + 1 rarest
of the larger, and a shingle's place bounds what the two can still share, and so the sizes that can
be met from there: those are part of the key. An edited copy whose own shingles are too many to link
with anything finds no partner. What does link is first gathered around the most typical member of
each list, and pairs within one component are never compared, as they can't change it.

So members of lists of more than SHORT documents retain all their hashes, not K of them, and get their
candidates from these: the results are the same, but this part's lists aren't those of a bottom-k sketch.
K values can't tell a similarity of 0.75 from one of 0.5, so in a crowd of texts that share a passage their
lists alone would compare nearly all with all.
A shingle that a third of all documents hold is a hot key where postings meet its count. The counts
are written first, so that both sides of this join are plain exchanges, and what follows deals out by
document: adaptive execution then splits such a key over many tasks. The prefix cut drops it after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactuslab.llm.common import LOWER, SPACES, discard, mixed, saved, shingle_hashes, span_hashes, text_chunks, word_class, words
from tactuslab.llm.components import components

SHINGLE = 5
K = 64
NEED = 30
#: Documents in a list that are compared each with each.
SHORT = 16
#: Growth of set size from one size class to the next.
SIZE_STEP = 1.03
_WORD = word_class(SPACES)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, below 2 ** 63."""
    for _, buf, starts in text_chunks(column):
        buf = LOWER[buf]
        first, end, at = words(buf, starts, _WORD)
        hashes = span_hashes(buf, first, end)
        shingles = shingle_hashes(hashes, SHINGLE) >> np.uint64(1)
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = b - a
            if n >= SHINGLE:
                own = np.sort(shingles[a : b - SHINGLE + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                yield shingle_hashes(hashes[a:b], n) >> np.uint64(1) if n else hashes[:0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, two numbers that name the set (0 for none), and its K smallest hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, low = [], [], [], []
            for own in _sets(batch.column(1)):
                n.append(len(own))
                s1.append(np.add.reduce(own * np.uint64(0x9E3779B97F4A7C15)))
                s2.append(np.add.reduce(mixed(own)))
                low.append(own[:K])
            sums = [pa.array(np.array(x, np.uint64).astype(np.int64)) for x in (s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *sums, _lists(low)], names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "sketch"])

    return documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, sketch array<long>")


def _full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, n, set and sketch of the wanted documents."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                own = list(_sets(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in own], pa.int64()), _lists(own), _lists([x[:K] for x in own])], names=["rep", "n", "set", "sketch"])

    docs = documents.select(F.col("doc_id").cast("long"), "text").join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return docs.mapInArrow(full, "rep long, n long, set array<long>, sketch array<long>")


def _near_size(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def _prefix_lists(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """value, rep and n: the inverted lists of each class's rarest retained values, those of two or more; and the table of counts they come from."""
    kept = F.size("sketch")
    room = kept - F.least(F.lit(NEED), F.ceil(F.col("n_shingles") * 0.75)) + 1
    postings = classes.select("rep", F.col("n_shingles").alias("n"), kept.alias("kept"), room.alias("room"), F.explode("sketch").alias("value"))
    shared = saved(postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    some = postings.join(shared, "value")
    own = some.groupBy("rep", "n", "kept", "room").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))  # K at most
    first = F.slice("v", 1, F.greatest(F.lit(0), F.col("room") - (F.col("kept") - F.size("v"))).cast("int"))
    return own.select("rep", "n", F.explode(first).alias("v")).select("v.value", "rep", "n"), shared


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketch of the union lets pass and whose full sets are near enough."""
    side = lambda c, *cols: sets.select(F.col("rep").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in cols))
    est = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, K)
    both = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    whole = (F.col("n_a") <= K) & (F.col("n_b") <= K)
    least = F.when(whole & (F.size(union) < K), 0.75).otherwise(NEED / K)
    est = est.where(_near_size(F.col("n_a"), F.col("n_b"))).where(both >= least * F.size(union)).select("a", "b")
    full = est.join(side("b", "n", "set"), "b").join(side("a", "n", "set"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return full.where(100 * common >= 75 * (F.col("n_a") + F.col("n_b") - common)).select("a", "b").distinct()


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP))).cast("int")


def _exact_lists(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """value, size_class, rep, n, place, typical, and whether the row is one for the smaller or the larger of a pair; and the table of counts.

    place counts a set's shingles from the rarest; those that no other set has come first. typical is
    the share of shingles that another set has too.
    """
    postings = sets.select("rep", "n", F.explode("set").alias("value"))
    shared = saved(postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    far = F.col("n") - F.ceil(F.col("n") * 0.75) + 1
    own = postings.join(shared, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))  # one set
    own = own.select("rep", "n", (F.size("v") / F.col("n")).alias("typical"), (F.col("n") - F.size("v")).alias("alone"), F.slice("v", 1, F.greatest(F.lit(0), far - F.col("n") + F.size("v")).cast("int")).alias("v"))
    rows = own.select("rep", "n", "typical", "alone", F.posexplode("v").alias("k", "x")).select("rep", "n", "typical", (F.col("alone") + F.col("k") + 1).alias("place"), "x.value")
    rest = F.col("n") - F.col("place") + 1  # what can still be shared from here on
    # 7 * common >= 3 * (n + m) bounds the size m of the other set.
    low, high = F.ceil(F.col("n") * 0.75), F.least(F.col("n"), F.floor(rest * 7 / 3.0).cast("long") - F.col("n"))
    large = rows.where(low <= high).withColumn("size_class", F.explode(F.sequence(_size_class(low), _size_class(high)))).withColumn("large", F.lit(True))
    small = rows.where(7 * rest >= 6 * F.col("n")).withColumn("size_class", _size_class(F.col("n"))).withColumn("large", F.lit(False))
    return large.unionByName(small), shared


def _apart(lists: DataFrame, label: DataFrame, *key: str) -> DataFrame:
    """Rows of those lists that hold more than one component, with it as c."""
    own = lists.join(label.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("c", F.coalesce("label", "rep")).drop("label")
    apart = own.groupBy(*key).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(*key)
    return own.join(apart, list(key), "left_semi")


def class_components(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """node and label of the classes that are linked with others."""
    lists, counts = _prefix_lists(classes.where("rep IS NOT NULL"))
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = saved(lists.join(sizes, "value"), "lists")
    discard(counts)
    sets = saved(_full_sets(documents, lists.select("rep").distinct()), "sets")

    crowd = lists.where(F.col("m") > SHORT).select("rep").distinct()
    exact, counts = _exact_lists(sets.join(crowd, "rep", "left_semi"))
    exact = saved(exact, "exact-lists")
    discard(counts)
    head = F.max(F.struct("typical", (-F.col("rep")).alias("first"))).alias("head")
    heads = exact.groupBy("value", "size_class").agg(head, F.count(F.lit(1)).alias("m")).where("m > 1")
    star = exact.select("value", "size_class", "rep").join(heads, ["value", "size_class"]).groupBy("rep").agg(F.max("head").alias("head"))
    star = star.withColumn("head", -F.col("head.first")).where(F.col("rep") != F.col("head"))
    links = saved(_linked(star.select(*_ordered("head", "rep")), sets), "links")
    label = components(links)

    own = _apart(exact, label, "value", "size_class")
    small = own.where("NOT large").select("value", "size_class", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("c").alias("c2"))
    common = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1
    near = (F.col("c") != F.col("c2")) & (F.col("n2") <= F.col("n")) & (7 * common >= 3 * (F.col("n") + F.col("n2")))
    pairs = own.where("large").join(small, ["value", "size_class"]).where(near).select(*_ordered("rep", "rep2"))

    own = _apart(lists.where(F.col("m") <= SHORT), label, "value")
    other = own.select("value", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    near = (F.col("rep") < F.col("rep2")) & (F.col("c") != F.col("c2")) & _near_size(F.col("n"), F.col("n2"))
    pairs = pairs.unionByName(own.join(other, "value").where(near).select(*_ordered("rep", "rep2"))).distinct()
    more = saved(_linked(pairs, sets), "links")
    out = components(links.unionByName(more))
    discard(lists, sets, exact, links, label, more)
    return out


def near_duplicates(documents: DataFrame, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of documents (doc_id, text).

    A row's set is its distinct five-word shingles, its whole sequence where it has fewer words, and
    empty without words; an empty set is linked with nothing. Documents are linked from a similarity
    of 0.75; component_id is the smallest doc_id that can be reached, and kept tells whether it is the
    row's own. doc_id is a whole number. Repeated rows get equal answers. A doc_id is meant to name one text: groups of equal sets
    whose smallest doc_id is the same are one node, so texts that share it are in one component, with
    all that any of them is linked with. Rows with a null doc_id have the component of the documents with their set, or
    null. Other columns aren't read. An empty table gives an empty one. with_hash
    adds text_hash, xxhash64 of the text.
    """
    own = saved(sketches(documents), "sketches")
    classes = own.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = saved(classes, "classes")
    label = class_components(classes, documents)
    named = classes.select("n_shingles", "s1", "s2", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("n_shingles", "s1", "s2", F.coalesce("label", "rep").alias("component"))
    rows = own.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(named, ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", *["text_hash"] * with_hash, "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    out = saved(rows, "near-duplicates")
    discard(own, classes, label)
    return out
