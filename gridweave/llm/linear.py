"""Bounded samples of labelled rows, and small numpy classifiers fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """The ``most`` ids, at most, with the smallest hashes: the same ones in every run.

    An id's repeated rows are one after the map-side part of distinct().
    """
    ids = rows.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    return ids.orderBy(F.xxhash64("id"), "id").limit(most)


def with_texts(docs: DataFrame, ids: list, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each of a bounded list of ids; of rows that repeat an id, the smallest text's."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], f"id {docs.schema[id_col].dataType.simpleString()}")
    cols = [F.col(c) for c in columns]
    some = docs.join(F.broadcast(wanted), docs[id_col] == wanted["id"]).select(F.col("id"), F.struct(*cols).alias("r"))
    return some.groupBy("id").agg(F.min("r").alias("r")).select(F.col("id").alias(id_col), "r.*")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights of a logistic model; the last is the intercept. Rows of weight 0 don't count."""
    weight = np.ones(len(x)) if weight is None else weight
    w, adam, total = np.zeros(x.shape[1] + 1), Adam(x.shape[1] + 1, rate), max(weight.sum(), 1e-9)
    for _ in range(rounds):
        # products in the matrix's own precision: no wider copy of it is made
        slope = (sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y) * weight / total
        g = np.append((slope.astype(x.dtype) @ x).astype(float) + l2 * w[:-1], slope.sum())
        w = adam.step(w, g)
    return w


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
