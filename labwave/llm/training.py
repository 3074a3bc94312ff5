"""Fitting a text model on a bounded sample of labelled rows, and sending it to the scorers.

The sample is the ``max_rows`` labelled rows with the smallest hash of their id, so
it does not depend on partitions or order; only those rows' texts travel, to one
task, which returns the model as one row of fixed size. Scoring reads every row
with the model as a broadcast variable, whose size is that of the weight table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package

#: Labelled rows that a model is fitted on.
TRAIN_ROWS = 8192


class Ftrl:
    """Follow-the-regularised-leader (proximal) for sparse linear models: per-coordinate
    rates from the sum of squared gradients, weights of small evidence exactly zero.
    With ``positive``, weights below zero are held at zero."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float, positive: bool = False):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive

    def weights(self, ids=slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where((z >= 0.0) & self.positive | (np.abs(z) <= self.l1), 0.0, w)

    def update(self, ids: np.ndarray, weights: np.ndarray, gradients: np.ndarray) -> None:
        """``ids`` are distinct; ``weights`` are their current weights."""
        n, g2 = self.n[ids], gradients * gradients
        self.z[ids] += gradients - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * weights
        self.n[ids] = n + g2


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None = None,
                   max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, label): at most ``max_rows`` labelled documents, one text for an id.

    An id with several labels gets the more frequent one (ties: 1); null ids, null
    labels and ids outside ``allowed`` teach nothing.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_rows rows of two numbers
                 .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("label")))
    return texts


def fit(sample: DataFrame, train: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The weights that ``train`` makes of the whole bounded sample, in one task."""
    ship_package(sample.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        frame = pd.concat(rows) if rows else pd.DataFrame({"doc_id": [], "text": [], "label": []})
        frame = frame.sort_values("doc_id", ignore_index=True)
        yield pd.DataFrame({"model": [train(frame).astype("<f4").tobytes()]})

    models = sample.repartition(1).mapInPandas(run, "model binary").collect()  # one row, as long as the weight table
    if not models:  # Spark starts no task for a sample that it knows to be empty
        return train(pd.DataFrame({"text": [], "label": []})).astype("<f4")
    return np.frombuffer(bytes(models[0]["model"]), dtype="<f4")
