"""What several operators share: models fitted in a task, and byte-level word arrays.

Words are found in UTF-8 bytes. Every byte of a non-ASCII character is 0x80 or above, so a
word class that holds all non-ASCII characters is the same class of bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tactuslab.tables import discard, saved, shared_dir

CHUNK_BYTES = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def fitted(sample: DataFrame, order: list, fit: Callable[[Iterator[pa.RecordBatch]], object]) -> object:
    """What fit makes of the batches of sample, a table of bounded size, in order: in one task, so
    that the driver gets the model and none of the rows, and a lost executor costs one more try.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(batches))], pa.binary())})

    made = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(task, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit(iter(()))


def hash_reach(share: float) -> int:
    """The number that so large a share of all 64-bit hashes doesn't exceed."""
    return (1 << 63) - 1 if share >= 1 else int(-(1 << 63) + share * ((1 << 64) - 1))


def word_class(excluded: bytes) -> np.ndarray:
    """For each byte whether it is part of a word: all but the excluded ones."""
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into runs of rows of about limit bytes (one row at least).

    Yields the first row, the bytes with a zero byte after each text, and the start of each text
    in them with the total length last. A null counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        at = offsets[row : end + 1] - offsets[row]
        yield row, np.insert(data[offsets[row] : offsets[end]], at[1:], 0), at + np.arange(end - row + 1)
        row = end


def words(buf: np.ndarray, starts: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the first word of each text with the count last."""
    inside = in_word[buf]
    inside[starts[1:] - 1] = False
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    first, end = edges[::2], edges[1::2]
    return first, end, np.searchsorted(first, starts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running polynomial over all of them."""
    global _powers, _inverse
    if len(_powers) < len(buf):
        n = max(len(buf), CHUNK_BYTES + (1 << 16))
        steps = np.full(n, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _inverse = np.multiply.accumulate(steps)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers[: len(buf)], out=total[1:])
    own = (total[end] - total[first]) * _inverse[np.minimum(first, len(buf) - 1)] if len(buf) else total[first]
    return mixed(own + (end - first).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        out += hashes[k : k + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mixed(out)


def free(df: DataFrame, *names: str) -> list[str]:
    """names, lengthened where df has a column of that name already, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


KINDS = {"double": DoubleType(), "int": IntegerType(), "long": LongType(), "string": StringType(), "longs": ArrayType(LongType()), "strings": ArrayType(StringType())}


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df with more fields, given by type names."""
    more = [StructField(name, KINDS[kind]) for name, kind in kinds.items()]
    return StructType([*df.schema.fields, *more])


__all__ = [
    "LOWER", "SPACES", "discard", "fitted", "free", "hash_reach", "mixed", "saved", "shared_dir", "shingle_hashes", "span_hashes", "text_chunks", "with_fields", "word_class", "words",
]
