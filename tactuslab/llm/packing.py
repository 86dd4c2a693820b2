"""Packing: documents cut into windows of at most 2048 tokens by order-preserving dynamic programming.

The documents of a task form one stream of tokens in their order. Windows may be cut at document
ends, at sentence ends for a penalty, and, where a sentence is longer than a window, within it for a
larger one. f(j) is the least padding and penalty up to cut j. A window of L tokens is padded to the
size, so f(j) = size - j + penalty(j) + min(f(i) + i) over the cuts i within one window, and a
monotone queue holds the candidates for that minimum; a window whose length is a power of two isn't
padded, so those few lengths are looked up as well. penalty(j) holds WINDOW_COST, a cost of every
window that keeps short ones from being cut without need. The stream is solved in segments of bounded
size, each of which begins with a window of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain, repeat
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tactuslab.llm.common import with_fields

SIZE = 2048
END = 1
#: Costs of a cut, in tokens of padding.
SENTENCE_CUT = 8
WORD_CUT = 64
#: Cost of a window whatever its length, so that short ones aren't cut without need.
WINDOW_COST = 64
#: Tokens of a stream that are solved, and held, at once.
SEGMENT_TOKENS = 1 << 20
#: Texts that are looked up at once.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256
#: Words whose ids a task remembers.
CACHE_WORDS = 600_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters that normalisation changes in nothing but case.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = punctuation.encode()
#: How a byte-level vocabulary writes the bytes that aren't printable, from character 256 on.
_UNPRINTED = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_WRITTEN = {b: 256 + k for k, b in enumerate(_UNPRINTED)}


class WordTokenizer:
    """Ids of texts by a byte-level tokenizer that lower-cases and whose pieces never reach over white space.

    Each distinct word between ASCII white space is lower-cased, encoded once and remembered, as what stands
    before the marks that it ends with, and these: after a letter they are a piece of their own.
    A-Z may be lower-cased before the tokenizer composes characters only where no mark can join one of
    them: texts with a character from U+0300 to U+037F (bytes CC and CD) are encoded whole, and so are
    texts that may hold a special token.
    """

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(vocabulary)
        self._limit = cache_words
        #: How special tokens begin.
        self._special = {t.content.encode()[:2] for t in self._own.get_added_tokens_decoder().values()}
        self.sentence_ends = np.array([self._own.token_to_id(t) for t in (".</w>", "!</w>", "?</w>") if self._own.token_to_id(t) is not None])
        self.forget()

    def forget(self) -> None:
        self._index: dict[bytes, int] = {}
        self._flat = np.zeros(1 << 16, np.uint16 if self._own.get_vocab_size() <= 1 << 16 else np.uint32)
        self._start = np.zeros(1 << 14, np.int64)
        self._used = 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._own.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        self._add_plain([w for w in new if w.isalpha()])
        new = [w for w in new if not w.isalpha()]
        stems, tails = [], []
        for w in new:
            stem = w.rstrip(_MARKS)
            if not (stem[-1:].isalpha() or (stem and stem[-1] > 127 and _PLAIN.fullmatch(stem.decode()[-1]))):
                stem = w
            stems.append(stem)
            tails.append(w[len(stem) :])
        self._add_plain([x for x in dict.fromkeys(stems + tails) if x and x not in self._index])
        rest = [(w, a, b) for w, a, b in zip(new, stems, tails, strict=True) if w not in self._index]
        # The ids of a word that isn't its own stem are those of its two parts.
        parts = np.array([k for _, a, b in rest for k in (self._index[a], self._index[b] if b else -1)], np.int64)
        size = np.where(parts < 0, 0, self._start[parts + 1] - self._start[parts])
        self._add([w for w, _, _ in rest], size.reshape(-1, 2).sum(1), self._gather(self._start[parts], size))

    def _gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Runs of remembered ids, one after the other."""
        end = np.cumsum(size)
        return self._flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)]

    def _add_plain(self, new: list[bytes]) -> None:
        """Encode words: letters without normalisation to do straight by the model, the others by the whole chain."""
        model = self._own.model
        ids: list[list[int] | None] = []
        for w in new:
            if w.isalpha():  # a-z: written as they are
                ids.append([x.id for x in model.tokenize(w.decode())])
            elif _PLAIN.fullmatch(t := w.decode()):
                ids.append([x.id for x in model.tokenize(t.lower().encode().decode("latin-1").translate(_WRITTEN))])
            else:
                ids.append(None)
        other = iter(self._encoded([w.decode() for w, x in zip(new, ids, strict=True) if x is None]))
        ids = [next(other) if x is None else x for x in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(new, sizes, np.fromiter(chain.from_iterable(ids), self._flat.dtype, int(sizes.sum())))

    def _add(self, new: list[bytes], sizes: np.ndarray, flat: np.ndarray) -> None:
        n, used = len(self._index), self._used
        while used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while n + len(new) + 1 > len(self._start):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
        self._used = used + len(flat)
        self._flat[used : self._used] = flat
        self._start[n + 1 : n + 1 + len(new)] = used + np.cumsum(sizes)
        self._index.update(zip(new, range(n, n + len(new)), strict=True))

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as 32-bit numbers; none for null."""
        data = [(t or "").encode() for t in texts]
        words: list[bytes] = []
        counts, whole = [], {}
        for k, d in enumerate(data):
            if b"\xcc" in d or b"\xcd" in d or any(s in d for s in self._special):
                whole[k] = np.array(self._encoded([texts[k]])[0], np.uint32)
                counts.append(0)
                continue
            own = d.lower().split()
            words += own
            counts.append(len(own))
        if len(self._index) > self._limit:
            self.forget()
        at = np.fromiter(map(self._index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            own = [words[k] for k in missing.tolist()]
            self._learn(list(dict.fromkeys(own)))
            at[missing] = np.fromiter(map(self._index.__getitem__, own), np.int64, len(own))
        size = self._start[at + 1] - self._start[at]
        flat = self._gather(self._start[at], size).astype(np.uint32)
        bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return [whole.get(k, flat[bounds[k] : bounds[k + 1]]) for k in range(len(data))]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and the penalty of each cut. No two neighbours lie more than size apart."""
    final = np.zeros(1 << 16, bool)
    final[sentence_ends] = True
    ends = np.flatnonzero(final[np.minimum(ids, len(final) - 1)]) + 1
    at = np.union1d(ends, doc_ends)
    before = np.concatenate([[0], at[:-1]]) if len(at) else at
    long = np.flatnonzero(at - before > size)
    within = [np.arange(before[k] + size, at[k], size) for k in long]
    points = np.union1d(at, np.concatenate(within)) if within else at
    penalty = np.full(len(points), float(WORD_CUT))
    penalty[np.isin(points, ends)] = SENTENCE_CUT
    penalty[np.isin(points, doc_ends)] = 0
    return points.astype(np.int64), penalty


def windows(points: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Ends of the windows that cost least in padding and penalties; the last point is the last end."""
    n = len(points)
    at = np.concatenate([[0], points])
    whole: list[list[int]] = [[] for _ in range(n + 1)]  # cuts that lie a power of two before
    for b in range(size.bit_length()):
        i = np.searchsorted(at, at - (1 << b))
        for k in np.flatnonzero((at[i] == at - (1 << b)) & (1 << b <= size)).tolist():
            whole[k].append(int(i[k]))
    at, pen = at.tolist(), [0.0, *(penalty + WINDOW_COST).tolist()]
    cost, back = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost + place, place, index: costs rise
    for k in range(1, n + 1):
        j = at[k]
        while queue[0][1] < j - size:
            queue.popleft()
        first = queue[0]
        best, frm = first[0] + size - j, first[2]
        for i in whole[k]:
            if cost[i] < best:
                best, frm = cost[i], i
        best += pen[k]
        cost[k], back[k] = best, frm
        value = best + j
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j, k))
    ends, k = [], n
    while k:
        ends.append(at[k])
        k = back[k]
    return ends[::-1]


def _pieces(ids: list[np.ndarray], tokens: WordTokenizer, size: int) -> tuple[list[np.ndarray], int]:
    """Document, start, length, crc, tokens, sequence and offset of each piece of a segment; and its sequences."""
    flat = np.concatenate(ids)
    doc_ends = np.cumsum([len(x) for x in ids])
    ends = np.array(windows(*cut_points(flat, doc_ends, tokens.sentence_ends, size), size))
    cuts = np.union1d(ends, doc_ends)
    begin = np.concatenate([[0], cuts[:-1]])
    doc = np.searchsorted(doc_ends, begin, "right")
    sequence = np.searchsorted(ends, begin, "right")
    seq_begin = np.concatenate([[0], ends])[sequence]
    data = flat.astype("<u4")
    crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(begin, cuts, strict=True)], np.int64)
    doc_begin = np.concatenate([[0], doc_ends])[doc]
    return [doc, begin - doc_begin, cuts - begin, crc, doc_ends[doc] - doc_begin, sequence, begin - seq_begin], len(ends)


def pack(documents: DataFrame, size: int = SIZE, vocabulary: str | None = None, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The pieces of all documents, with the columns of documents but its text.

    Adds start, length, ids_crc32, doc_tokens, sequence_id and offset. A document's ids are those of
    its text, then END; a null or empty text has END alone. Documents keep the order in which the
    tasks read them and none is moved between machines; sequence_id is unique over all tasks.
    Repeated rows are packed each. Columns of these names in documents are replaced. An empty table
    gives no pieces.
    """
    added = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    documents = documents.drop(*added)
    column = documents.columns.index("text")
    path = vocabulary or default_vocabulary()
    names = [c for c in documents.columns if c != "text"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(path)
        sequence = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] = []
        rows: list[pa.RecordBatch] = []
        total = 0

        def solved() -> pa.RecordBatch:
            nonlocal sequence
            (doc, start, length, crc, n, seq, offset), many = _pieces(held, tokens, size)
            base = pa.Table.from_batches(rows).combine_chunks().take(pa.array(doc))
            more = [start, length, crc, n, seq + sequence, offset]
            sequence += many
            out = pa.table([*base.columns, *(pa.array(x, pa.int64()) for x in more)], names=[*names, *added])
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            for part in _slices(batch, column):
                own = [np.append(x, np.uint32(END)) for x in tokens.ids(part.column(column).to_pylist())]
                held += own
                rows.append(part.select(names) if names else part)
                total += sum(map(len, own))
                if total >= segment_tokens:
                    yield solved()
                    held, rows, total = [], [], 0
        if held:
            yield solved()
        tokens.forget()  # what later tasks of other kinds need is memory

    kinds = with_fields(documents, **dict.fromkeys(added, "long"))
    kinds = type(kinds)([f for f in kinds.fields if f.name != "text"])
    return documents.mapInArrow(packed, kinds)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_BYTES of text, one row at least and SLICE_ROWS at most."""
    ends = np.cumsum(pc.binary_length(batch.column(column).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < batch.num_rows:
        room = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SLICE_BYTES, "right"))
        end = min(max(k + 1, room), k + SLICE_ROWS)
        yield batch.slice(k, end - k)
        k = end


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, which reads the vocabulary once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
