"""A small tanh network on synthetic data, its gradient check, and regression metrics.

Fitting is driver-side NumPy over a sample of fixed size (128 rows); metrics run in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINTS = (0, 1, 5, 10, 25, 50, 100, 200, 400)
SIZES = {"train": 128, "validation": 64, "test": 64}


def errors(rows: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    return rows.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae")).withColumn("rmse", F.sqrt("mse"))


def synthetic(spark: SparkSession, seed: int) -> DataFrame:
    """(split, x, y): y = sin(pi x) + sin(3 pi x) / 4 + noise, reproducible for a seed."""
    parts = []
    for k, (name, n) in enumerate(SIZES.items()):
        rows = spark.range(0, n, 1, 1).select(F.lit(name).alias("split"), (F.rand(seed + 2 * k) * 2 - 1).alias("x"), (F.randn(seed + 2 * k + 1) * 0.05).alias("noise"))
        parts.append(rows.select("split", "x", (F.sin(F.pi() * F.col("x")) + F.sin(3 * F.pi() * F.col("x")) / 4 + F.col("noise")).alias("y")))
    return parts[0].union(parts[1]).union(parts[2])


@dataclass
class Network:
    """One hidden tanh layer and a linear output, fitted by full-batch Adam on the mean squared error."""

    hidden: int = 8
    seed: int = 20261015
    rate: float = 0.03
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        rng, bound = np.random.default_rng(self.seed), np.sqrt(6 / (1 + self.hidden))
        self.weights = [rng.uniform(-bound, bound, (1, self.hidden)), np.zeros((1, self.hidden)), rng.uniform(-bound, bound, (self.hidden, 1)), np.zeros((1, 1))]

    def predict(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean((self.predict(x) - y) ** 2))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, _ = self.weights
        a = np.tanh(x @ w1 + b1)
        out = 2 * (self.predict(x) - y) / len(x)
        back = (out @ w2.T) * (1 - a**2)
        return [x.T @ back, back.sum(0, keepdims=True), a.T @ out, out.sum(0, keepdims=True)]

    def gradient_error(self, x: np.ndarray, y: np.ndarray, step: float = 1e-6) -> float:
        """The largest difference between the gradients and central differences."""
        worst = 0.0
        for w, g in zip(self.weights, self.gradients(x, y), strict=True):
            for at in np.ndindex(w.shape):
                kept = w[at]
                w[at] = kept + step
                high = self.loss(x, y)
                w[at] = kept - step
                low = self.loss(x, y)
                w[at] = kept
                worst = max(worst, abs(g[at] - (high - low) / (2 * step)))
        return worst

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 400):
        """Yields the epoch at every checkpoint."""
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        yield 0
        for epoch in range(1, epochs + 1):
            for k, g in enumerate(self.gradients(x, y)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= self.rate * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
            if epoch in CHECKPOINTS:
                yield epoch


def run(spark: SparkSession, seed: int = 20261015) -> DataFrame:
    """(epoch, split, mse, rmse, mae); the test split is read only after fitting has ended."""
    data = synthetic(spark, seed)
    arrays = lambda name: np.array([tuple(r) for r in data.filter(F.col("split") == name).select("x", "y").collect()])
    train, held, net, rows = arrays("train"), arrays("validation"), Network(seed=seed), []
    if net.gradient_error(train[:8, :1], train[:8, 1:]) > 1e-5:
        raise ArithmeticError("gradients differ from central differences")
    note = lambda epoch, name, xy: rows.extend((epoch, name, float(y), float(p)) for y, p in zip(xy[:, 1], net.predict(xy[:, :1])[:, 0], strict=True))
    for epoch in net.fit(train[:, :1], train[:, 1:]):
        note(epoch, "train", train)
        note(epoch, "validation", held)
    note(CHECKPOINTS[-1], "test", arrays("test"))
    return errors(spark.createDataFrame(rows, "epoch int, split string, y double, p double"), "y", "p", ("epoch", "split"))
