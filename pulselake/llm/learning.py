"""What the two classifiers share: the training fold, a bounded labelled sample, sums over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that a classifier is fitted on, at most (in expectation; a hash picks them).
FIT_ROWS = 20_000
FOLDS = 5
#: Rows of a matrix that tasks hand over together.
BLOCK_ROWS = 256


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold, about ``rows`` at most.

    The labels of an id are reduced to the greatest, and its texts to the least; null ids and
    labels are dropped. Only ids and labels of the bounded sample are broadcast, and only its
    texts are shuffled.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(~held_out(F.col("doc_id")))
    share = min(1.0, rows / max(1, known.count()))
    drawn = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    picked = known.filter(drawn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def sum_blocks(partials: DataFrame, shape: tuple[int, int], salts: int = 64) -> np.ndarray:
    """Sum of the int64 matrices whose row blocks (block, values binary) the tasks have emitted.

    Blocks are summed in two steps, so a group holds at most 1/``salts`` of the tasks' blocks;
    the result, bounded by ``shape``, comes to the driver.
    """

    def add(keys: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py(), np.int64) for v in table["values"]], axis=0)
        return pa.table({"block": pa.array([keys[0].as_py()], pa.int32()), "values": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, values binary"
    some = partials.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("block", "salt").applyInArrow(add, schema)
    total = np.zeros(shape, np.int64)
    for row in some.groupBy("block").applyInArrow(add, schema).toLocalIterator():
        values = np.frombuffer(bytes(row["values"]), np.int64).reshape(-1, shape[1])
        first = row["block"] * BLOCK_ROWS
        total[first : first + len(values)] += values
    return total


def emit_blocks(matrix: np.ndarray) -> pa.RecordBatch:
    """The blocks of a task's int64 matrix that are not all zero."""
    blocks = [(k // BLOCK_ROWS, part.tobytes()) for k in range(0, len(matrix), BLOCK_ROWS) if (part := matrix[k : k + BLOCK_ROWS]).any()]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([v for _, v in blocks], pa.binary())], names=["block", "values"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two layers (ReLU, then a logit) in numpy, trained by Adam, with a calibrated temperature."""

    def __init__(self, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature, self.prior = 1.0, 0.5
        self.weights: list[np.ndarray] | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """A fifth of the rows is kept for the temperature. With one class or none the score is the label mean (0.5)."""
        if len(y) == 0 or y.min() == y.max():
            self.prior = float((y.sum() + 1) / (len(y) + 2))
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        kept, train = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, np.sqrt(1 / self.hidden), self.hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        epochs = max(self.epochs, 4000 // max(1, len(train) // 128))
        for epoch in range(epochs):
            rate = self.rate * (1 - epoch / epochs) + 1e-4
            for at in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
                step += 1
                hidden = np.maximum(0, z[at] @ w[0] + w[1])
                error = (sigmoid(hidden @ w[2] + w[3]) - y[at]) / len(at)
                back = np.outer(error, w[2]) * (hidden > 0)
                slopes = [z[at].T @ back + self.decay * w[0], back.sum(axis=0), hidden.T @ error + self.decay * w[2], error.sum(keepdims=True)]
                for k, g in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] = w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        if len(kept):
            logits = self.logits(x[kept])
            loss = lambda t: np.logaddexp(0, np.where(y[kept] > 0, -logits, logits) / t).mean()
            self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(0, (x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if self.weights is None:
            return np.full(len(x), self.prior)
        return sigmoid(self.logits(x) / self.temperature)
