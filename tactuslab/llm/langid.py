"""Language ID: a convolutional network over bytes.

Every byte has a vector; filters of several widths slide over a window of bytes, each keeps its
highest response, and a linear softmax reads these. All of it is trained in numpy on labelled text.
A text is cut into windows of a fixed length that cover it whole; the probabilities of its windows,
weighted by their bytes, are its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactuslab.llm.common import LOWER, fitted, hash_reach, text_chunks, with_fields
from tactuslab.llm.toxicity import held_out

WINDOW = 128
DIM = 6
WIDTHS = (2, 3, 5)
FILTERS = 16
#: Languages that can be learned: the most frequent ones.
MAX_LANGUAGES = 500
#: Labelled rows of each language to train on, at most, and characters of all, an equal share for each language.
MAX_ROWS = 400
MAX_CHARS = 3_000_000
UNKNOWN = "und"
_BATCH = 512  # windows


def _windows(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of bytes, rows filled up with 0, the text of each, and how many bytes it has of it."""
    size = np.diff(starts) - 1
    many = np.maximum(1, -(-size // WINDOW))
    text = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = starts[text] + k * WINDOW
    own = np.clip(size[text] - k * WINDOW, 0, WINDOW)
    at = first[:, None] + np.arange(WINDOW)
    data = LOWER[buf][np.minimum(at, len(buf) - 1)]
    data[np.arange(WINDOW) >= own[:, None]] = 0
    return data, text, own


@dataclass
class LanguageNet:
    """Vectors of bytes, filters of each width as (width * DIM, FILTERS) with their constants, and the softmax."""

    names: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    constants: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def features(self, data: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """What each filter's highest response is, and where, with the inputs of all responses."""
        x = self.vectors[data]
        kept, found = [], []
        for width, f, c in zip(WIDTHS, self.filters, self.constants, strict=True):
            n = data.shape[1] - width + 1
            step = np.lib.stride_tricks.as_strided(x, (len(x), n, width * DIM), (x.strides[0], x.strides[1], x.itemsize))
            y = (step.reshape(-1, width * DIM) @ f).reshape(len(x), n, FILTERS)
            found.append(np.maximum(y.max(1) + c, 0))
            kept.append((step, y))
        return np.concatenate(found, 1), kept

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.features(data[k : k + _BATCH])[0] for k in range(0, len(data), _BATCH)]) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 where it is null or has no letter."""
        if not self.names:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        names, scores = [], []
        letters = _has_letter(column)
        for row, buf, starts in text_chunks(column, 1 << 20):
            data, text, own = _windows(buf, starts)
            weighted = self.probabilities(data) * own[:, None]
            total = np.add.reduceat(weighted, np.searchsorted(text, np.arange(len(starts) - 1)))
            total /= np.maximum(np.add.reduceat(own, np.searchsorted(text, np.arange(len(starts) - 1))), 1)[:, None]
            best = total.argmax(1)
            for k, b in enumerate(best):
                names.append(self.names[b] if letters[row + k] else UNKNOWN)
                scores.append(float(min(total[k, b], 1.0)) if letters[row + k] else 0.0)
        return names, np.array(scores)


def _has_letter(column: pa.Array) -> list[bool]:
    out = []
    for x in column:
        t = x.as_py()
        out.append(t is not None and any(map(str.isalpha, t)))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.004, seed: int = 5) -> LanguageNet:
    """Fit on windows of labelled texts by Adam on their cross entropy; without texts it knows no language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    net = LanguageNet(names, normal(256, DIM), [normal(w * DIM, FILTERS) / np.float32((w * DIM) ** 0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), len(names)) / 8, np.zeros(len(names), np.float32))
    if not texts:
        return net
    chunks = [(row, *_windows(buf, starts)) for row, buf, starts in text_chunks(pa.array(texts, pa.large_string()))]
    data = np.concatenate([c[1] for c in chunks])
    of = np.concatenate([c[0] + c[2] for c in chunks])
    data, of = data[np.concatenate([c[3] for c in chunks]) >= 8], of[np.concatenate([c[3] for c in chunks]) >= 8]
    label = np.array([names.index(x) for x in labels])[of]
    count = np.bincount(label, minlength=len(names))
    weight = (len(label) / np.maximum(count, 1) / len(names))[label].astype(np.float32)
    parts = [net.vectors, *net.filters, *net.constants, net.out, net.bias]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            t += 1
            for p, g, m, s in zip(parts, _gradients(net, data[rows], label[rows], weight[rows]), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return net


def _gradients(net: LanguageNet, data: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    found, kept = net.features(data)
    z = found @ net.out + net.bias
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(label)), label] -= 1
    z *= weight[:, None] / len(label)
    d = (z @ net.out.T) * (found > 0)
    vectors = np.zeros_like(net.vectors)
    filters, constants = [], []
    for i, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        step, y = kept[i]
        where = y.argmax(1)
        own = d[:, i * FILTERS : (i + 1) * FILTERS]
        rows = np.arange(len(data))[:, None]
        x = step[rows, where]  # the input of each filter's highest response
        filters.append(np.einsum("bfi,bf->if", x, own))
        constants.append(own.sum(0))
        back = own[:, :, None] * f.T[None]  # batch, filter, width * DIM
        for j in range(width):
            np.add.at(vectors, data[rows, where + j], back[:, :, j * DIM : (j + 1) * DIM])
    return [vectors, *filters, *constants, found.T @ z, z.sum(0)]


def fit(documents: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_languages: int = MAX_LANGUAGES) -> LanguageNet:
    """Train on at most max_rows documents of each of the max_languages most frequent languages and max_chars characters.

    Of each language the rows with the smallest hashes of their ids, never held-out ones, whole texts
    but for the last, which is cut to what is left of the language's share: so every language is
    learned, however long its texts are. Rows with a null id, text or lang are passed over. One job
    counts the languages, another brings about max_rows of each to the task that fits.
    """
    docs = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    share = max(1, max_chars // max(1, len(counts)))
    within = [(r["lang"], hash_reach((max_rows + 6 * max_rows**0.5 + 6) / r["count"])) for r in counts]
    known = F.broadcast(documents.sparkSession.createDataFrame(within, "lang string, _reach long"))  # max_languages rows
    sample = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("_h")).join(known, "lang").where(F.col("_h") <= F.col("_reach"))
    sample = sample.select("lang", "_h", "doc_id", F.substring("text", 1, share).alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> LanguageNet:
        texts, langs, rows, room = [], [], Counter(), Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text[: share - room[lang]]
                if text and rows[lang] < max_rows:
                    texts.append(text)
                    langs.append(lang)
                    rows[lang] += 1
                    room[lang] += len(text)
        return train(texts, langs)

    return fitted(sample, ["lang", "_h", "doc_id", "text"], learn)


def identify(documents: DataFrame, model: LanguageNet) -> DataFrame:
    """Add lang_pred and score to every row, from its whole text alone.

    lang_pred is UNKNOWN, with the score 0, where the text is null or has no letter. Repeated rows get
    equal answers; columns of these names in the input are replaced. An empty table gives an empty one.
    """
    documents = documents.drop("lang_pred", "score")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    names = documents.columns
    column = names.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch.column(column))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return documents.mapInArrow(predict, with_fields(documents, lang_pred="string", score="double"))
