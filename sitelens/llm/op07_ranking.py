"""Quality scores by Bradley-Terry ranking.

A pair (better, worse) is won with probability sigmoid(u(better) - u(worse)), u linear in counts of
the text. The weights come from logistic loss on feature differences of preference pairs; the
utility at the quantile that equals the share of poor training texts becomes score 0.5.

Cases: a null or empty text is scored like a text without words. Repeated rows and ids give one row
each; a doc_id with two labels counts as the lower one. Other columns of documents are not read.
Without labels of both kinds all scores are 0.5. Equal utilities get equal scores; a score of 0.5 counts
as label 1. A very long text is a block of its own, about 27 bytes a byte of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, texts
from .stats import N_TEXT, Counts

#: labelled documents that training reads at most, and pairs drawn from them
TRAIN_ROWS, PAIRS = 20_000, 100_000
FEATURES = "doc_id long, features array<double>"


class Ranking:
    def __init__(self, center: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float):
        self.center, self.scale, self.weights, self.threshold = center, scale, weights, threshold

    def utility(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.utility(x) - self.threshold, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                x = Counts(data, off).text_features()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a),
                     pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_TEXT, dtype=np.int32), pa.array(x.ravel()))], ["doc_id", "features"])

    return texts(docs).mapInArrow(run, FEATURES)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, seed: int = 7) -> Ranking:
    """Newton steps on the logistic loss of differences; pairs are drawn with a fixed seed."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return Ranking(np.zeros(N_TEXT), np.ones(N_TEXT), np.zeros(N_TEXT), 0.0)
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z, rng = (x - center) / scale, np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(poor, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (1 - p) / pairs - l2 * w
        h = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    u = np.sort(z @ w)
    k = len(poor)
    return Ranking(center, scale, w, float((u[k - 1] + u[k]) / 2))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, pairs: int = PAIRS) -> Ranking:
    """From labels that are not held out: the max_rows documents with the smallest id hashes, so that
    the sample keeps the shares of both labels, which the quantile needs."""
    marked = (labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("y")))
    part = F.broadcast(marked.orderBy(F.xxhash64("doc_id")).limit(max_rows))  # at most max_rows ids
    got = features(texts(docs).join(part.select("doc_id"), "doc_id", "left_semi")).join(part, "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features")).toPandas()
    if not len(got):
        return fit(np.zeros((0, N_TEXT)), np.zeros(0))
    order = np.lexsort([*np.stack(got["features"]).T, got["y"]])
    return fit(np.stack(got["features"])[order], got["y"].to_numpy()[order], pairs)


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, score of every text."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a),
                                                  pa.array(model.score(Counts(data, off).text_features()))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def rank(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with held-out marks and verdicts at 0.5, the quantile threshold."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: Ranking, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score at least the threshold."""
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch, names[at]):
                yield batch.slice(a, b - a).filter(pa.array(model.score(Counts(data, off).text_features()) >= threshold))

    return docs.mapInArrow(run, schema)
