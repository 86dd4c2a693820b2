"""Benchmark decontamination: a prefix-filtered join of documents with item-sized windows.

A window is 10 consecutive words of a benchmark item, or the whole item where it has fewer. It can
stand in a document only if each of its shingles does, so one shingle is a sufficient prefix: the
rarest, as counted over all documents. Documents look up their shingles among these; a hit fixes
where the window would lie, its length has to fit between the document's ends, and then all of its
words are compared, by hash and then by their bytes. A benchmark of bounded size is indexed in arrays,
which tasks get by broadcast. A larger one is joined as tables, by the same prefixes and bounds, and takes
as many passes over the documents whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactuslab.llm.common import LOWER, discard, free, saved, shingle_hashes, span_hashes, text_chunks, with_fields, word_class, words

WINDOW = 10
#: Words of a shingle; items with fewer words are indexed by single words.
SHINGLE = 5
#: Benchmark characters that the driver holds and tasks get at once; a larger benchmark is joined as tables.
BLOCK_CHARS = 2_000_000
WORD = word_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def _lowered_words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf = LOWER[buf]
    return buf, *words(buf, starts, WORD)


@dataclass
class Windows:
    """Distinct windows of a block. word: hashes of all words of its items; text: these, lower-cased, with a
    blank after each, and where each begins. A window begins at word first and has length words; of its
    items the names are ids[item[owner[k]:owner[k + 1]]], none for an item without an id.
    """

    word: np.ndarray
    text: bytes
    begin: np.ndarray
    first: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    item: np.ndarray
    ids: list[str]

    @staticmethod
    def of(items: list[tuple[str | None, str]], window: int) -> Windows:
        ids = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(ids)}
        parts, word, first, length, item, sizes = [], [], [], [], [], [np.zeros(1, np.int64)]
        words_before = 0
        for row, buf, starts in text_chunks(pa.array([t for _, t in items], pa.large_string())):
            buf, lo, hi, at = _lowered_words(buf, starts)
            word.append(span_hashes(buf, lo, hi))
            n = hi - lo + 1  # with the blank
            flat = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            spaced = buf[np.minimum(flat, max(len(buf) - 1, 0))] if len(buf) else buf
            spaced[np.cumsum(n) - 1] = 32
            parts.append(spaced.tobytes())
            sizes.append(n)
            many = np.diff(at)  # words of each item
            wide = np.minimum(many, window)
            windows = np.where(many > 0, many - wide + 1, 0)
            of = np.repeat(np.arange(len(many)), windows)
            first.append(words_before + at[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows))
            length.append(wide[of])
            item.append(np.array([number.get(i, -1) for i, _ in items[row : row + len(many)]], np.int64)[of])
            words_before += len(lo)
        none = [np.zeros(0, np.int64)]
        first, length, item, begin = (np.concatenate(x or none) for x in (first, length, item, sizes))
        own = Windows(np.concatenate(word or [np.zeros(0, np.uint64)]), b"".join(parts), np.cumsum(begin), first, length, none[0], none[0], ids)
        return own._distinct(item)

    def _distinct(self, item: np.ndarray) -> Windows:
        """One window of those with equal words, with the items of all."""
        name = np.zeros(len(self.first), np.uint64)
        for n in np.unique(self.length):
            own = self.length == n
            name[own] = shingle_hashes(self.word, int(n))[self.first[own]]
        order = np.lexsort((self.length, name))
        same = (np.diff(name[order]) == 0) & (np.diff(self.length[order]) == 0)
        # Equal hashes of unequal words are told apart by their bytes.
        for k in np.flatnonzero(same):
            same[k] = self._bytes(order[k]) == self._bytes(order[k + 1])
        head = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        pairs = np.unique(np.stack([group, item[order]], 1)[item[order] >= 0], axis=0) if len(order) else np.zeros((0, 2), np.int64)
        owner = np.searchsorted(pairs[:, 0], np.arange(int(head.sum()) + 1))
        return replace(self, first=self.first[order][head], length=self.length[order][head], owner=owner, item=pairs[:, 1])

    def _bytes(self, k: int) -> bytes:
        return self.text[self.begin[self.first[k]] : self.begin[self.first[k] + self.length[k]]]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, window and place in it of each shingle of the windows; windows shorter than width have words as shingles."""
        own = np.where(self.length >= width, width, 1)
        many = self.length - own + 1
        window = np.repeat(np.arange(len(own)), many)
        place = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
        at = self.first[window] + place
        hashes = np.zeros(len(at), np.uint64)
        for w in np.unique(own):
            some = own[window] == w
            hashes[some] = shingle_hashes(self.word, int(w))[at[some]]
        return hashes, window, place


@dataclass
class Prefixes:
    """The windows filed under their rarest shingle: shingle, window and place, ordered by shingle."""

    windows: Windows
    key: np.ndarray
    window: np.ndarray
    place: np.ndarray
    widths: tuple[int, ...]


def _sizes(windows: Windows, width: int) -> tuple[int, ...]:
    short = bool(len(windows.length)) and int(windows.length.min()) < width
    long = bool(len(windows.length)) and int(windows.length.max()) >= width
    return (width,) * long + (1,) * short


class _Seen:
    """Finds those of many hashes that are among known ones: a table of bits first, then a search."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        self.bits = np.zeros(1 << 22, bool)
        self.bits[known >> np.uint64(42)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.bits[hashes >> np.uint64(42)])
        where = np.searchsorted(self.known, hashes[at])
        hit = self.known[np.minimum(where, len(self.known) - 1)] == hashes[at] if len(self.known) else np.zeros(0, bool)
        return at[hit], where[hit]


def _count_shingles(documents: DataFrame, known: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """How often each of the known shingles stands in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(known)  # of a block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(shared.value)
        total = np.zeros(len(seen.known), np.int64)
        for batch in batches:
            for _, buf, starts in text_chunks(batch.column(0)):
                buf, first, end, at = _lowered_words(buf, starts)
                hashes = span_hashes(buf, first, end)
                for w in widths:
                    at_shingle, where = seen.find(shingle_hashes(hashes, w))
                    text = np.searchsorted(at, at_shingle, "right")
                    within = at_shingle + w <= at[np.minimum(text, len(at) - 1)]
                    total += np.bincount(where[within], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    counts = np.zeros(len(known), np.int64)
    for r in documents.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return counts


def prefixes(documents: DataFrame, windows: Windows) -> Prefixes:
    """File each window under its rarest shingle over all documents (of equals, the first in it)."""
    hashes, window, place = windows.shingles(SHINGLE)
    known, code = np.unique(hashes, return_inverse=True)
    widths = _sizes(windows, SHINGLE)
    counts = _count_shingles(documents, known, widths) if len(known) else np.zeros(0, np.int64)
    order = np.lexsort((place, counts[code], window))
    first = order[np.unique(window[order], return_index=True)[1]]
    first = first[np.argsort(hashes[first], kind="stable")]
    return Prefixes(windows, hashes[first], window[first], place[first], widths)


def _find(p: Prefixes, seen: _Seen, begin: np.ndarray, many: np.ndarray, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and window of each occurrence of a window; and the first word of each text."""
    buf, first, end, at = _lowered_words(buf, starts)
    hashes = span_hashes(buf, first, end)
    texts, words_at, windows_at = [], [], []
    for w in p.widths:
        at_shingle, where = seen.find(shingle_hashes(hashes, w))
        reps = many[where]
        entry = np.repeat(begin[where] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        window, start = p.window[entry], np.repeat(at_shingle, reps) - p.place[entry]
        n = p.windows.length[window]
        ok = (start >= 0) & ((n >= SHINGLE) == (w > 1))
        window, start, n = window[ok], start[ok], n[ok]
        text = np.searchsorted(at, start, "right") - 1
        ok = start + n <= at[np.minimum(text + 1, len(at) - 1)]  # between the document's ends
        window, start, n, text = window[ok], start[ok], n[ok], text[ok]
        for k in range(int(n.max(initial=0))):
            other = p.windows.word[np.minimum(p.windows.first[window] + k, len(p.windows.word) - 1)]
            ok = (k >= n) | (hashes[np.minimum(start + k, len(hashes) - 1)] == other)
            window, start, n, text = window[ok], start[ok], n[ok], text[ok]
        same = [b"".join(buf[first[x] : end[x]].tobytes() + b" " for x in range(a, a + c)) == p.windows._bytes(v) for v, a, c in zip(window, start, n, strict=True)]
        same = np.array(same, bool)
        texts.append(text[same]), words_at.append(start[same]), windows_at.append(window[same])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(texts or none), np.concatenate(words_at or none), np.concatenate(windows_at or none), at


def _scan(documents: DataFrame, p: Prefixes) -> DataFrame:
    """Add n_words, spans of words that are hit (begin and end, one after the other) and items to each row."""
    names = documents.columns
    column = names.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(p)  # of a block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        known, begin, many = np.unique(p.key, return_index=True, return_counts=True)
        seen = _Seen(known)
        for batch in batches:
            counts, spans, items = [], [], []
            for _, buf, starts in text_chunks(batch.column(column)):
                text, word, window, at = _find(p, seen, begin, many, buf, starts)
                order = np.lexsort((word, text))
                text, word, window = text[order], word[order], window[order]
                bounds = np.searchsorted(text, np.arange(len(starts)))
                counts.append(np.diff(at))
                for k in range(len(starts) - 1):
                    a, b = bounds[k], bounds[k + 1]
                    spans.append(_joined(word[a:b] - at[k], word[a:b] - at[k] + p.windows.length[window[a:b]]) if a < b else [])
                    items.append(_names(p.windows, window[a:b]) if a < b else [])
            more = [np.concatenate(counts) if counts else [], spans, items]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(more, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True))], names=[*names, "n_words", "spans", "items"])

    return documents.mapInArrow(scan, with_fields(documents, n_words="long", spans="longs", items="strings"))


def _names(windows: Windows, some: np.ndarray) -> list[str]:
    """The ids of the items that have some windows, in order."""
    some = np.unique(some)
    many = windows.owner[some + 1] - windows.owner[some]
    at = np.repeat(windows.owner[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
    return [windows.ids[k] for k in np.unique(windows.item[at])]


def _joined(begin: np.ndarray, end: np.ndarray) -> list[int]:
    """Spans that touch or overlap made one: begin, end, begin, end and so on."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])
    return np.stack([begin[new], end[last]], 1).ravel().tolist()


def _window_rows(items: DataFrame, window: int) -> DataFrame:
    """words, n, shingles and items of the windows of (item, text): distinct in each slice of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                own = Windows.of(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), window)
                hashes, of, _ = own.shingles(SHINGLE)
                at = np.searchsorted(of, np.arange(len(own.first) + 1)).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64)))
                text = [own._bytes(v) for v in range(len(own.first))]
                names = [[own.ids[i] for i in own.item[a:b]] for a, b in zip(own.owner, own.owner[1:])]  # noqa: B905
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(own.length, pa.int32()), shingles, pa.array(names, pa.list_(pa.string()))], names=["words", "n", "shingles", "items"])

    return items.mapInArrow(cut, "words binary, n int, shingles array<long>, items array<string>")


def _text_shingles(documents: DataFrame, widths: tuple[int, ...], counted: bool) -> DataFrame:
    """The shingles of each text: key (a hash of the text), n_words, the word at which each begins; or counted, how many there are in a chunk of texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, buf, starts in text_chunks(batch.column(1)):
                buf, first, end, at = _lowered_words(buf, starts)
                hashes = span_hashes(buf, first, end)
                for w in widths:
                    own = shingle_hashes(hashes, w).view(np.int64)
                    text = np.searchsorted(at, np.arange(len(own)), "right") - 1
                    within = np.arange(len(own)) + w <= at[text + 1]
                    own, text, place = own[within], text[within], np.flatnonzero(within)
                    if counted:
                        own, n = np.unique(own, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n, pa.int64())], names=["shingle", "n"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(keys[row + text], pa.int64()), pa.array(at[text + 1] - at[text], pa.int64()), pa.array(place - at[text], pa.int64()), pa.array(own)], names=["key", "n_words", "at", "shingle"])

    return documents.select(F.xxhash64("text").alias("key"), "text").mapInArrow(cut, "shingle long, n long" if counted else "key long, n_words long, at long, shingle long")


def _verified(found: DataFrame) -> DataFrame:
    """name, spans and the windows that do occur, for texts (name, text, found: where which window's words may stand)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, spans, windows = [], [], []
            for row, buf, starts in text_chunks(batch.column(1)):
                buf, first, end, at = _lowered_words(buf, starts)
                for k in range(len(starts) - 1):
                    begin, stop, own = [], [], set()
                    for f in batch.column(2)[row + k].as_py():
                        a, n = int(at[k]) + f["start"], f["n"]
                        if a + n <= at[k + 1] and b"".join(buf[first[x] : end[x]].tobytes() + b" " for x in range(a, a + n)) == f["words"]:
                            begin.append(f["start"]), stop.append(f["start"] + n), own.add(f["words"])
                    if own:
                        names.append(batch.column(0)[row + k].as_py())
                        spans.append(_joined(np.array(begin), np.array(stop)))
                        windows.append(sorted(own))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(spans, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.binary()))], names=["name", "spans", "windows"])

    return found.mapInArrow(check, "name string, spans array<long>, windows array<binary>")


def _joined_tables(documents: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """name (SHA-256), spans and items of each text with a hit: the same join, with nothing but tables.

    Shingles of the windows are counted over all documents; a window with one that occurs nowhere goes, and
    each other is filed under its rarest. Texts meet these prefixes in a join, and of what lies between a
    text's ends every word is compared. Equal texts are one from there on.
    """
    rows = saved(_window_rows(items, window), "windows")
    windows = rows.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    parts = windows.select("words", F.col("n").alias("length"), F.posexplode("shingles").alias("place", "shingle"))
    sizes = rows.agg(F.min("n"), F.max("n")).collect()[0]
    widths = (SHINGLE,) * (sizes[1] is not None and sizes[1] >= SHINGLE) + (1,) * (sizes[0] is not None and sizes[0] < SHINGLE)
    counts = _text_shingles(documents, widths, True).groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = saved(counts.join(parts.select("shingle").distinct(), "shingle", "left_semi"), "counts")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("p")
    prefix = parts.join(counts, "shingle", "left").groupBy("words", "length").agg(rarest).where("p.n > 0")
    prefix = saved(prefix.select("words", "length", "p.place", "p.shingle"), "prefixes")

    start = F.col("at") - F.col("place")
    meet = _text_shingles(documents, widths, False).join(prefix, "shingle").where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    meet = meet.select("key", start.alias("start"), F.col("length").alias("n"), "words").distinct()
    found = saved(meet.groupBy("key").agg(F.collect_list(F.struct("start", "n", "words")).alias("found")), "candidates")  # within one text
    texts = documents.select(F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("name"), "text").join(found, "key")
    hits = _verified(texts.select("name", "text", "found")).groupBy("name").agg(F.first("spans").alias("spans"), F.first("windows").alias("windows"))
    hits = saved(hits, "hits")

    owners = saved(rows.select("words", F.explode("items").alias("item")).distinct(), "owners")
    named = hits.select("name", F.explode("windows").alias("words")).join(owners, "words").select("name", "item").distinct()
    named = named.groupBy("name").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = saved(hits.select("name", "spans").join(named, "name", "left"), "contamination")
    discard(rows, counts, prefix, found, hits, owners)
    return out


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add n_words, spans and items to each document: which words lie in windows of which items.

    Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. spans holds begin and
    end of each run of hit words, items the ids whose windows occur, as strings in order: a row names as
    many as occur in it. Null and empty texts have no words; the windows of an item with a null id hit
    words like others, but there is no id to name; items without words have no window; items that share
    an id count once. Each row is judged by its text alone, so repeated rows get equal answers. Columns
    of these names in documents are replaced. With an empty benchmark nothing is hit. A benchmark of up
    to block_chars characters is an index that tasks get; a larger one is joined as tables. Either way
    the number of passes over the documents is fixed: two, or four.
    """
    documents = documents.drop("n_words", "spans", "items")
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    chars = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    if chars <= block_chars:
        block = [(r["item"], r["text"]) for r in items.collect()]
        return _scan(documents, prefixes(documents, Windows.of(block, window)))
    key, more_spans, more_items = free(documents, "_text", "_spans", "_items")
    more = _joined_tables(documents, items, window).select(F.col("name").alias(key), F.col("spans").alias(more_spans), F.col("items").alias(more_items))
    out = _scan(documents, prefixes(documents, Windows.of([], window))).withColumn(key, F.sha2("text", 256)).join(more, key, "left")
    spans, ids = F.coalesce(more_spans, F.col("spans")), F.coalesce(more_items, F.col("items"))
    return out.select(*documents.columns, "n_words", spans.alias("spans"), ids.alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from spans and items."""
    size = F.aggregate(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), F.lit(0).cast("long"), lambda s, k: s + F.element_at("spans", k + 1) - F.element_at("spans", k))
    n_hit = F.when(F.size("spans") > 0, size).otherwise(F.lit(0).cast("long"))
    return found.select("*", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM doc, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)),
hit AS (SELECT rid, i, occ.n, item_id FROM occ JOIN win ON occ.n = win.n AND occ.t = win.t),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit), unnest(range(i, i + n)) AS u(p) GROUP BY rid),
items AS (SELECT rid, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""
