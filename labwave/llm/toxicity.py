"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences. Each sentence's probability is a logistic
model over hashed features of its distinct words (the word and its beginnings of 3 to 8
letters) whose weights are never negative, so that harmless words around an insult
don't hide it; the document's is the noisy-or 1 - prod(1 - p) of its sentences. Only
document labels are known; the gradient of the noisy-or hands a positive label to
the sentences that explain it. The same model then says which sentences offend.

Defined cases: a null or empty text, or one without a word, has no sentence and
scores 0; without any labelled row every sentence has the prior and nothing is
reported at the threshold; rows are scored one by one, so repeated rows and other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .training import TRAIN_ROWS, Ftrl, fit, labelled_texts

BINS = 1 << 18
EPOCHS = 6
#: Part of a toxic document's words that an epoch leaves out (the last two leave out
#: none), so that every insult is learned and not only those that suffice together.
LEFT_OUT = 0.4
MEMO = 300_000
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
#: Log-odds of a sentence about which nothing is known.
PRIOR = -9.0
BEGINNINGS = range(3, 9)

#: Words, and the signs that end a sentence.
TOKEN = re.compile(r"\w+|[.!?\n]+")
_END = frozenset(".!?\n")


def word_bins(word: str) -> np.ndarray:
    forms = {f"={word}"} | {f"^{word[:k]}" for k in BEGINNINGS if k < len(word) or k == len(word)}
    return np.array(sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % BINS for x in forms}), dtype=np.int64)


def bag(text: str | None, memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a text: the bins of all words, the sentence and the word of each bin, and the
    number of sentences."""
    parts, at, sentence, seen = [], [], 0, set()
    for token in TOKEN.findall((text or "").lower()):
        if token[0] in _END:
            sentence += bool(seen)
            seen = set()
            continue
        if token in seen:
            continue
        seen.add(token)
        bins = memo.get(token)
        if bins is None:
            bins = memo[token] = word_bins(token)
        parts.append(bins)
        at.append(sentence)
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
    sizes = [len(x) for x in parts]
    return np.concatenate(parts), np.repeat(np.array(at), sizes), np.repeat(np.arange(len(parts)), sizes), at[-1] + 1


def train(sample: pd.DataFrame) -> np.ndarray:
    model = Ftrl(BINS, alpha=2.0, beta=1.0, l1=0.5, l2=0.0, positive=True)
    memo: dict[str, np.ndarray] = {}
    rows = []
    for text, y in zip(sample["text"], sample["label"]):
        bins, at, word, sentences = bag(text, memo)
        if len(bins):
            ids, where = np.unique(bins, return_inverse=True)
            rows.append((ids.astype(np.int32), where.astype(np.int32), at.astype(np.int32), word.astype(np.int32), sentences, int(y)))
    rng = np.random.default_rng(4)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, where, at, word, n, y = rows[i]
            w = model.weights(ids)
            use = 1.0
            if y and epoch < EPOCHS - 2:
                use = (rng.random(word[-1] + 1) >= LEFT_OUT)[word].astype(float)
            z = PRIOR + np.bincount(at, weights=w[where] * use, minlength=n)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            if y:
                none = np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
                slope = -p * none / max(1.0 - none, 1e-12)
            else:
                slope = p
            if np.abs(slope).max() > 1e-6:
                model.update(ids, w, np.bincount(where, weights=slope[at] * use, minlength=len(ids)))
    return model.weights()


class WordWeights(dict):
    """word -> the sum of its bins' weights; the signs that end a sentence -> nan."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) > MEMO:
            self.clear()
        value = self[token] = float("nan") if token[0] in _END else float(self.weights[word_bins(token)].sum())
        return value


def sentence_odds(tokens: list[str], known: WordWeights) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each sentence, and the position of its first token."""
    w = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
    end = np.isnan(w)
    first = np.flatnonzero(~end & np.append(True, end[:-1]))
    if not len(first):
        return np.empty(0), first
    odds = np.full(len(first), PRIOR)
    said = set()
    for i in np.flatnonzero(w > 0.0).tolist():
        at = int(np.searchsorted(first, i, side="right")) - 1
        if (at, tokens[i]) not in said:  # a repeated word says nothing new
            said.add((at, tokens[i]))
            odds[at] += w[i]
    return odds, first


def noisy_or(odds: np.ndarray) -> float:
    """1 - prod(1 - p), from log-odds; log(1 - p) = -log(1 + exp(odds))."""
    return float(-np.expm1(-np.logaddexp(0.0, odds).sum())) if len(odds) else 0.0


def offending(text: str, known: WordWeights, threshold: float) -> list[dict]:
    """Spans, in code points, of the sentences at or above ``threshold``."""
    found = list(TOKEN.finditer(text))
    # Lower-casing may change a text's length, so words are lowered one by one.
    odds, first = sentence_odds([m[0].lower() for m in found], known)
    out = []
    for k, at in enumerate(first):
        p = 1.0 / (1.0 + np.exp(-np.clip(odds[k], -30, 30)))
        if p >= threshold:
            stop = next((j for j in range(at, len(found)) if found[j][0][0] in _END), len(found))
            out.append({"start": found[at].start(), "end": found[stop - 1].end(), "score": float(p)})
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed=None, max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from ``labels`` (doc_id, toxic) of the documents."""
    return fit(labelled_texts(docs, labels, "toxic", allowed, max_rows), train)


def score_toxicity(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD,
                   sentence_threshold: float = SENTENCE_THRESHOLD) -> DataFrame:
    """``docs`` with struct ``toxicity``: score, and the offending sentences (start,
    end, score) of documents at or above ``threshold``."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(weights)  # BINS numbers

    @F.pandas_udf("score double, sentences array<struct<start:long,end:long,score:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        known = WordWeights(sent.value)
        scores, spans = [], []
        for text in texts.array:
            text = text or ""
            odds, _ = sentence_odds(TOKEN.findall(text.lower()), known)
            scores.append(noisy_or(odds))
            spans.append(offending(text, known, sentence_threshold) if scores[-1] >= threshold else [])
        return pd.DataFrame({"score": scores, "sentences": spans})

    return docs.withColumn("toxicity", judge(F.col("text")))
