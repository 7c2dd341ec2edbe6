"""A feed-forward classifier of encoded vectors: gradients are summed where the rows are, the model is a small table written each round."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .ranges import running

#: Units of the two hidden layers, rounds, step size and seed.
HIDDEN, ROUNDS, RATE, SEED = (256, 128), 10, 0.001, 42
#: Numbers of a gradient that one row holds.
SLICE = 1 << 12

# Decay of Adam's two moments, and what keeps its divisor from 0.
DECAY, LEAST = (0.9, 0.999), 1e-8


def ordered_split(rows: DataFrame, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """rows with `train`: whether a row is among the first `share` in the order, which tells rows apart."""
    placed = running(rows.withColumn("_one", F.lit(1)), [], order, "_one", "_place")
    n = placed.agg(F.count("*").alias("_n"))
    return placed.join(F.broadcast(n)).withColumn("train", F.col("_place") < F.floor(F.col("_n") * share)).drop("_one", "_place", "_n")


class Network:
    """Weights of all layers as one vector: of each layer a matrix, then what is added."""

    def __init__(self, sizes: Sequence[int], values: np.ndarray):
        self.sizes, self.values = tuple(sizes), values

    @classmethod
    def start(cls, sizes: Sequence[int], seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        return cls(sizes, np.concatenate([np.append(r.uniform(-1, 1, a * b) / np.sqrt(a), r.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(sizes, sizes[1:])]))

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((self.values[at : at + a * b].reshape(a, b), self.values[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """What each layer gives for rows x, x itself first; the last are probabilities."""
        out, layers = [x], self.layers()
        for i, (w, c) in enumerate(layers):
            z = out[-1] @ w + c
            if i + 1 < len(layers):
                out.append(np.maximum(z, 0))
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(e / e.sum(axis=1, keepdims=True))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, int]:
        """Sums over the rows: the loss's gradient, the loss (cross entropy), and the right answers."""
        out = self.forward(x)
        rows = np.arange(len(y))
        loss = float(-np.log(np.maximum(out[-1][rows, y], 1e-300)).sum())
        right = int((out[-1].argmax(axis=1) == y).sum())
        delta = out[-1].copy()
        delta[rows, y] -= 1
        parts = []
        for (w, _), below in zip(reversed(self.layers()), reversed(out[:-1])):
            parts.append(np.append((below.T @ delta).ravel(), delta.sum(axis=0)))
            delta = (delta @ w.T) * (below > 0)
        return np.concatenate(parts[::-1]), loss, right


class Adam:
    """Step sizes from moments of the gradients."""

    def __init__(self, n: int, rate: float = RATE):
        self.rate, self.round, self.one, self.two = rate, 0, np.zeros(n), np.zeros(n)

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.round += 1
        a, b = DECAY
        self.one, self.two = a * self.one + (1 - a) * gradient, b * self.two + (1 - b) * gradient * gradient
        return self.rate * (self.one / (1 - a**self.round)) / (np.sqrt(self.two / (1 - b**self.round)) + LEAST)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    return x.reshape(batch.num_rows, -1).astype(np.float64), batch.column(1).to_numpy(zero_copy_only=False)


def gradient_sums(rows: DataFrame, network: Network, slice_: int = SLICE) -> tuple[np.ndarray, float, int, int]:
    """Gradient, loss, right answers and rows of (vector, label), each summed. Tasks sum their own rows; slices of the sums are added where they meet, so that one model's worth of numbers comes to the driver, however many tasks there are."""
    ddl = "slice int, part array<double>"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(network.values) + 3)
        for b in batches:
            if b.num_rows:
                x, y = _rows(b)
                gradient, loss, right = network.gradient(x, y)
                total += np.append(gradient, [loss, right, len(y)])
        if total[-1]:
            parts = [total[i : i + slice_] for i in range(0, len(total), slice_)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["slice", "part"])

    def add(table: pa.Table) -> pa.Table:
        x = table.column("part").combine_chunks()
        total = x.flatten().to_numpy().reshape(len(x), -1).sum(axis=0)
        return pa.table([table.column("slice")[:1], pa.array([total], pa.list_(pa.float64()))], names=["slice", "part"])

    found = rows.select("vector", "label").mapInArrow(own, ddl).groupBy("slice").applyInArrow(add, ddl).orderBy("slice").collect()
    total = np.concatenate([r.part for r in found]) if found else np.zeros(len(network.values) + 3)
    return total[:-3], float(total[-3]), int(total[-2]), int(total[-1])


def train(rows: DataFrame, classes: int, hidden: Sequence[int] = HIDDEN, rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED) -> tuple[Network, DataFrame]:
    """The network fitted on rows (vector, label 0 to classes - 1, train), and (round, train_loss, train_accuracy, test_accuracy) of each round, before its step.

    Each round takes one step along the gradient of all training rows. The model's numbers, a table of one row a round,
    are written before the next one.
    """
    spark = rows.sparkSession
    own = written(rows.select("vector", F.col("label").cast("int").alias("label"), "train"), "vectors")
    width = own.agg(F.max(F.size("vector"))).first()[0] or 0
    network = Network.start((width, *hidden, classes), seed)
    adam, history = Adam(len(network.values), rate), []
    for k in range(rounds):
        gradient, loss, right, n = gradient_sums(own.filter("train"), network)
        _, _, test_right, test_n = gradient_sums(own.filter("not train"), network)
        if n:
            network = Network(network.sizes, network.values - adam.step(gradient / n))
        state = json.dumps({"sizes": network.sizes, "values": network.values.tolist()})
        facts = (k, loss / n if n else None, right / n if n else None, test_right / test_n if test_n else None, state)
        history.append(written(spark.createDataFrame([facts], "round int, train_loss double, train_accuracy double, test_accuracy double, model string"), "model"))
    out = history[0]
    for more in history[1:]:
        out = out.unionByName(more)
    return network, out.drop("model")


def restored(row) -> Network:
    """The network of a written round."""
    own = json.loads(row.model)
    return Network(own["sizes"], np.array(own["values"]))


def classify(rows: DataFrame, network: Network) -> DataFrame:
    """(item, label, confidence) of rows (item, vector): the most probable class, and its probability."""
    kind = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = network.forward(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64))[-1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.argmax(axis=1), pa.int32()), pa.array(p.max(axis=1))], names=["item", "label", "confidence"])

    return rows.select("item", "vector").mapInArrow(run, f"item {kind}, label int, confidence double")
