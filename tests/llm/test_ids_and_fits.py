"""Token ids against the tokenizer itself, the gradients of toxicity, and what the fits learn from."""

import random
import unicodedata
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tactuslab.llm import langid, packing, toxicity

PARTS = [
    *"TtHhWwYyJjAaZz019.,'!?-<|>/", "̈", "̱", "̊", "̣", "́", "̀", "̈́", "̸", "ִ", "゙", "か", "é", "É", "é", "ß", "ẞ", "İ", "ı", "ſ", "K", "Å",
    "µ", "ª", "²", "½", "ﬁ", "Σ", "ς", "가", "ᄀ", "ᅡ", "क", "़", "ཱི", "ᴖ5", "😀", "‍", "​", "\xad", "﻿", "\x00", "\x1c", "\x85", "\xa0", " ", " ", "　", " ", " ", "\n", "\t",
    "'s", "'S", "'LL", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "<|", "endoftext", "Straße", "ÀÉ", "naïve", "ŒUVRE", "hello", "World",
]


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_those_of_the_tokenizer(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(8000)]
    texts += ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(60)) for _ in range(200)]
    own = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.WordTokenizer(packing.default_vocabulary()).ids(texts)
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_only_characters_that_are_looked_for_join_a_letter():
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        with_letter = {x for x in ascii_letters if not unicodedata.normalize("NFC", x + c).startswith(x)}
        assert not with_letter or c.encode()[0] in (0xCC, 0xCD), hex(ord(c))


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    n = 40
    table, out, bias = rng.standard_normal((n, toxicity.DIM)), rng.standard_normal(toxicity.DIM), 0.3
    per = rng.integers(1, 6, 12)
    words = (rng.integers(0, n, per.sum()), np.cumsum(per) - per, per)
    first, end = np.array([0, 3, 5, 7]), np.array([3, 5, 5, 12])  # one window is empty
    toxic = np.array([1.0, 0, 1, 0])

    def loss():
        total = 0.0
        for a, b, y in zip(first, end, toxic, strict=True):
            means = [np.mean([table[m] @ out for m in words[0][words[1][k] : words[1][k] + per[k]]]) for k in range(a, b)]
            p = 1 / (1 + np.exp(-(sum(means) / max(1, len(means)) + bias)))
            total -= np.log(p) if y else np.log(1 - p)
        return total

    places, g, g_out, b = toxicity._gradients(table, out, bias, words, first, end, toxic)
    for part, want in ((table, g[:, None] * out), (out, g_out)):
        for at in np.ndindex(want.shape):
            where = (places[at[0]], at[1]) if part is table else at
            old = part[where]
            part[where] = old + 1e-6
            up = loss()
            part[where] = old - 1e-6
            down = loss()
            part[where] = old
            assert (up - down) / 2e-6 == pytest.approx(want[at], rel=1e-4, abs=1e-7)
    bias += 1e-6
    up = loss()
    bias -= 2e-6
    assert (up - loss()) / 2e-6 == pytest.approx(b, rel=1e-4)


def test_grams_are_of_characters():
    pull = np.zeros(1 << toxicity.BITS)
    chars, first, end, at = toxicity._spaced(np.frombuffer("Éé 日本\0x\0".encode(), np.uint8), np.array([0, 12, 14]))
    assert chars.tolist() == [32, *map(ord, "Éé 日本"), 32, ord("x"), 32] and (end - first).tolist() == [2, 2, 1] and at.tolist() == [0, 2, 3]
    assert toxicity.Toxicity(pull, 0.0).scores(pa.array(["Éé", "", None])).tolist() == [0.5] * 3


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(k, "der und nicht über " * 4000, "de") for k in range(12)] + [(100 + k, "the and of with", "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, max_chars=8000)
    assert model.names == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    assert {got[0], got[11]} == {"de"} and got[100] == "en"
    assert langid.fit(docs, max_languages=1).names == ["en"]


def test_long_and_repeated_labelled_rows_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fitted", lambda sample, order, fit: seen.append(sample.orderBy(*order).toArrow().to_batches()) or fit(iter(seen[0])))
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts.to_pylist(), toxic.tolist())))
    rows = [(k, "x" * 500) for k in range(20)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, max_rows=7, max_chars=4000, max_text=450)
    texts, toxic = seen[1]
    for value in (0, 1):
        own = [len(t) for t, y in zip(texts, toxic, strict=True) if y == value]
        assert own == [450, 450, 450, 450, 200]
    assert docs.where(toxicity.held_out()).select(F.count_distinct("doc_id")).collect()[0][0] > 0
