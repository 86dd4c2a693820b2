"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself; every member has a vector in a hashed
table. A window of words is the average of its words' vectors, a linear softmax reads it, and
table and softmax are trained jointly by gradient descent in numpy. The score of a text is that
of its highest window, so that length does not dilute it; training follows the same window.
Misspellings that were never seen share most n-grams with words that were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactuslab.llm.common import LOWER, fitted, hash_reach, span_hashes, text_chunks, with_fields, word_class, words

GRAMS = (3, 4, 5, 6)
BITS = 17
DIM = 8
#: Words of a window. Two: of a longer one, the words around an insult are learned too, and those of unseen texts hide it.
WINDOW = 2
STEP = 1
#: Passes over the training rows: as many as make up so many characters, within these limits.
PASS_CHARS = 80_000_000
PASSES = (12, 40)
#: The last passes, in which the highest window of a text stands for it: a quarter, but so many at least.
HIGHEST_PASSES = 9
#: Bytes of texts that a step learns from.
STEP_BYTES = 1 << 14
THRESHOLD = 0.3
#: Rows of each label to train on; enough for the vocabulary of insults to recur.
MAX_ROWS = 2000
#: Characters of these rows' texts, half of them for each label, that the fitting task holds.
MAX_CHARS = 8_000_000
#: Characters of one text that can be learned from; of a longer one the first.
MAX_TEXT = 200_000

_WORD = word_class(bytes(b for b in range(128) if not chr(b).isalnum()))


@dataclass
class Toxicity:
    """Per member of the table, how far its vector moves the log odds; and their constant."""

    pull: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = [_window_logits(*_word_pulls(self.pull, buf, starts), self.bias) for _, buf, starts in text_chunks(column)]
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gram_places(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size n, the place in the table of the n characters from each character on."""
    key = np.zeros(len(chars), np.uint32)
    for n in range(1, GRAMS[-1] + 1):
        key = key[: len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1 :]
        if n in GRAMS:
            place = (key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
            yield n, place >> np.uint32(32 - BITS)


def _word_places(chars: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (span_hashes(chars, first, end) >> np.uint64(64 - BITS)).astype(np.int64)


def _spaced(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased characters with spaces for all that is no word, one more in front; words as words() gives them."""
    buf = LOWER[buf]
    if buf.max(initial=0) > 127:
        at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        chars, starts = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32), at[starts]
    else:
        chars = buf.astype(np.uint32)
    chars = np.concatenate([np.array([32], np.uint32), chars])
    first, end, at = words(np.minimum(chars, 128), np.concatenate([[1], starts[1:] + 1]), _WORD)
    chars[~_WORD[np.minimum(chars, 128)]] = 32
    return chars, first, end, at


def _word_pulls(pull: np.ndarray, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each word moves the log odds: the mean of its members. And the first word of each text."""
    buf, first, end, at = _spaced(buf, starts)
    total, count = pull[_word_places(buf, first, end)], np.ones(len(first))
    for n, place in _gram_places(buf):
        run = np.concatenate([[0.0], np.cumsum(pull[place])])
        many = np.maximum(end - first + 3 - n, 0)
        total += run[np.minimum(first - 1 + many, len(place))] - run[np.minimum(first - 1, len(place))]
        count += many
    return total / count, at


def _windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of each window, and the first window of each text with the count last.

    Windows begin every STEP words and the last ends with the text; a text without words has one, empty.
    """
    n = np.diff(at)
    many = np.where(n > WINDOW, -(-(n - WINDOW) // STEP) + 1, 1)
    begin = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(n)), many)
    first = at[text] + (np.arange(len(text)) - begin[text]) * STEP
    first = np.minimum(first, np.maximum(at[text + 1] - WINDOW, at[text]))
    return first, np.minimum(first + WINDOW, at[text + 1]), begin


def _window_logits(pulls: np.ndarray, at: np.ndarray, bias: float) -> np.ndarray:
    """The log odds of each text: of its highest window."""
    if len(at) < 2:
        return np.zeros(0)
    first, end, begin = _windows(at)
    total = np.concatenate([[0.0], np.cumsum(pulls)])
    mean = (total[end] - total[first]) / np.maximum(end - first, 1)
    return np.maximum.reduceat(mean, begin[:-1]) + bias


def train(texts: pa.Array, toxic: np.ndarray, rate: float = 0.15, seed: int = 7) -> Toxicity:
    """Fit on labelled texts. Each step takes one window of each text of a batch, any in the first
    passes and the highest in the last, and moves table and softmax by AdaGrad along the
    gradient of its cross entropy. Without both labels, every text gets the score 0.
    """
    rng = np.random.default_rng(seed)
    table = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / 100
    out = rng.standard_normal(DIM).astype(np.float32)
    bias, seen, seen_out = 0.0, np.full(1 << BITS, 1e-3, np.float32), np.full(DIM, 1e-3, np.float32)
    toxic = np.asarray(toxic).astype(np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        return Toxicity(np.zeros(1 << BITS, np.float32), -30.0)
    size = pc.sum(pc.binary_length(texts.cast(pa.large_binary()))).as_py() or 0
    # The members of all words lie in one array, which is given back whole: a byte begins no more of them than there are sizes and words.
    room = np.empty((len(GRAMS) + 1) * size, np.int32)
    parsed, used = [], 0
    for row, buf, starts in text_chunks(texts, STEP_BYTES):
        flat, *rest = _prepared(buf, starts)
        own = room[used : used + len(flat)]
        own[:] = flat
        used += len(flat)
        parsed.append((row + np.arange(len(starts) - 1), own, *rest))
    bias_seen = 1e-3
    chars = pc.sum(pc.utf8_length(texts)).as_py() or 0
    epochs = int(np.clip(PASS_CHARS // max(1, chars), *PASSES))
    highest = max(HIGHEST_PASSES, epochs // 4)
    for epoch in range(epochs):
        for k in rng.permutation(len(parsed)):
            rows, flat, start, per, at = parsed[k]
            first, end, begin = _windows(at)
            if epoch < epochs - highest:
                best = rng.integers(begin[:-1], begin[1:])
            else:
                pull = np.add.reduceat((table @ out)[flat], start) / per if len(start) else np.zeros(0)
                total = np.concatenate([[0.0], np.cumsum(pull)])
                mean = (total[end] - total[first]) / np.maximum(end - first, 1)
                best = np.array([b + int(np.argmax(mean[b:e])) for b, e in zip(begin[:-1], begin[1:], strict=True)])
            places, g, g_out, b = _gradients(table, out, bias, (flat, start, per), first[best], end[best], toxic[rows])
            seen[places] += g * g * (out @ out)
            table[places] -= rate * (g / np.sqrt(seen[places]))[:, None] * out
            seen_out += g_out * g_out
            out -= rate * g_out / np.sqrt(seen_out)
            bias_seen += b * b
            bias -= rate / 0.3 * b / bias_seen**0.5
    return Toxicity((table @ out).astype(np.float32), bias)


def _gradients(table: np.ndarray, out: np.ndarray, bias: float, words: tuple[np.ndarray, ...], first: np.ndarray, end: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the summed cross entropy of windows from word first to end: places of the table, what to
    multiply out with for the gradient of each one's vector, the gradient of out, and that of bias.
    """
    flat, start, per = words
    n = end - first
    word = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    window = np.repeat(np.arange(len(n)), n)
    member, reps = _flat(flat, start, per, word)
    share = np.repeat(1 / (per[word] * np.maximum(n, 1)[window]), reps)  # of a member in its window's mean
    window = np.repeat(window, reps)
    z = np.bincount(window, (table[member] @ out) * share, len(n)) + bias
    error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
    places, where = np.unique(member, return_inverse=True)
    g = np.bincount(where, error[window] * share, len(places)).astype(table.dtype)
    return places, g, g @ table[places], float(error.sum())


def _prepared(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members of all words one word after the other, where each word's begin, how many, and the words of each text."""
    buf, first, end, at = _spaced(buf, starts)
    members, word = [_word_places(buf, first, end).astype(np.int32)], [np.arange(len(first))]
    for n, place in _gram_places(buf):
        many = np.maximum(end - first + 3 - n, 0)
        word.append(np.repeat(np.arange(len(first)), many))
        members.append(place[np.arange(len(word[-1])) + np.repeat(first - 1 - np.cumsum(many) + many, many)].astype(np.int32))
    members, word = np.concatenate(members), np.concatenate(word)
    per = np.bincount(word, minlength=len(first))
    return members[np.argsort(word, kind="stable")], np.cumsum(per) - per, per, at


def _flat(flat: np.ndarray, start: np.ndarray, per: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    reps = per[word]
    at = np.repeat(start[word], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    return flat[at], reps


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_text: int = MAX_TEXT) -> Toxicity:
    """Train on at most max_rows documents of each label and max_chars characters, half for each label.

    The rows are those with the smallest hashes of their ids, never held-out ones. Texts are learned
    from whole, but for the first max_text characters of longer ones and for the last of each label,
    which is cut to what is left. Rows with a null id, text or label are passed over; of several
    labels of an id the highest counts. All of it runs in one task, and only the model is returned.
    """
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    # Only ids are joined with the labels. About max_rows of each label have hashes below its share of the range.
    ids = docs.select("doc_id").join(known, "doc_id")
    counts = {r["toxic"]: r["count"] for r in ids.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    within = F.lit(False)
    for value, n in counts.items():
        within = within | ((F.col("toxic") == value) & (F.col("_h") <= hash_reach((max_rows + 6 * max_rows**0.5 + 6) / n)))
    # At most a sixth more than max_rows of each label, but for a chance of one in a billion.
    chosen = F.broadcast(ids.distinct().withColumn("_h", F.xxhash64("doc_id")).where(within))
    sample = docs.join(chosen, "doc_id").select("_h", "doc_id", "toxic", F.substring("text", 1, max_text).alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Toxicity:
        texts, toxic, rows, room = [], [], {0: max_rows, 1: max_rows}, {0: max_chars // 2, 1: max_chars // 2}
        for batch in batches:
            for value, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if rows[value] and room[value]:
                    texts.append(text[: room[value]])
                    toxic.append(value)
                    rows[value] -= 1
                    room[value] -= len(texts[-1])
        return train(pa.array(texts, pa.large_string()), np.array(toxic))

    return fitted(sample, ["_h", "doc_id", "text"], learn)


def score_toxicity(documents: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """Add score and predicted to every row, from its whole text alone.

    Null and empty texts are scored as a text without words. Repeated rows get equal scores; columns
    named score and predicted in the input are replaced. An empty table gives an empty one.
    """
    documents = documents.drop("score", "predicted")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the input
    names = documents.columns
    at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return documents.mapInArrow(score, with_fields(documents, score="double", predicted="int"))
