"""Quality classifier: logistic regression over hashed word n-grams.

Features of a text, hashed to ``BINS`` weights: its words, pairs of neighbouring
words, the shapes of words (letter case, digits and the signs around them) and
pairs of shapes, a word that repeats the one before it being a shape of its own.
A feature's value is its count over the length of the count vector, so long and
short texts are on one scale. The weights come from follow-the-regularised-leader
updates over a bounded sample of labelled rows; a score is the logistic function
of one sparse dot product, over the whole text.

Defined cases: a null or empty text has no features and gets the score of the
bias alone; without any labelled row every score is 0.5 (predicted 1, so that
nothing is rejected without evidence); rows are scored one by one, so repeated
rows and other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship_package
from .training import TRAIN_ROWS, Ftrl, fit, labelled_texts

BINS = 1 << 18
EPOCHS = 2
MEMO = 300_000
THRESHOLD = 0.5

_BIAS, _REPEAT = 0, 1
_RUNS = re.compile(r"(.)\1+")
_CLASSES = [(re.compile(r"[^\W\d_a-z]"), lambda m: "A" if m[0].isupper() else "a"), (re.compile(r"[a-z]"), lambda m: "a"),
            (re.compile(r"\d"), lambda m: "0")]


def shape(word: str) -> str:
    """``Thend,`` is ``Aa,``; ``THE!!`` is ``A!``; ``ab12$$$`` is ``a0$``."""
    for pattern, by in _CLASSES:
        word = pattern.sub(by, word)
    return _RUNS.sub(r"\1", word)


class Words(dict):
    """word -> hash of the word * 2^32 + hash of its shape, computed when first met."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        low = zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))
        value = self[word] = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) >> 1) << 32 | low
        return value


_words = Words()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins and their values."""
    words = (text or "").split()
    if not words:
        return np.array([_BIAS]), np.array([1.0])
    both = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    word, form = (both >> 32).astype(np.uint64), (both & 0xFFFFFFFF).astype(np.uint64)
    again = word[1:] == word[:-1]
    form_pair = form[:-1] * np.uint64(0x9E3779B1) + form[1:] * np.uint64(0x85EBCA77)
    word_pair = word[:-1] * np.uint64(0xC2B2AE3D) + word[1:] * np.uint64(0x27D4EB2F)
    mix = lambda h, salt: ((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BINS - 2) + np.uint64(2)
    bins = np.concatenate([mix(word, 1), mix(form, 2), np.where(again, np.uint64(_REPEAT), mix(form_pair, 3)), mix(word_pair, 4)])
    ids, counts = np.unique(bins.astype(np.int64), return_counts=True)
    values = counts / np.sqrt(float(np.dot(counts, counts)))
    return np.append(ids, _BIAS), np.append(values, 1.0)


def train(sample: pd.DataFrame) -> np.ndarray:
    model = Ftrl(BINS, alpha=0.5, beta=1.0, l1=0.02, l2=0.01)
    rows = [(*features(t), float(y)) for t, y in zip(sample["text"], sample["label"])]
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, values, y = rows[i]
            w = model.weights(ids)
            p = 1.0 / (1.0 + np.exp(-np.clip(float(w @ values), -30, 30)))
            model.update(ids, w, (p - y) * values)
    return model.weights()


def fit_quality(docs: DataFrame, labels: DataFrame, allowed=None, max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from ``labels`` (doc_id, quality) of the documents."""
    return fit(labelled_texts(docs, labels, "quality", allowed, max_rows), train)


def score_quality(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 in ``column``."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(weights)  # BINS numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = sent.value
        out = np.empty(len(texts))
        for i, text in enumerate(texts.array):
            ids, values = features(text)
            out[i] = model[ids] @ values
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn(column, score(F.col("text")))


def keep_quality(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, columns unchanged."""
    column = fresh("quality")
    return score_quality(docs, weights, column).filter(F.col(column) >= threshold).drop(column)
