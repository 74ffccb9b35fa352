"""A pluggable neural term scorer: frozen vectors of terms, characteristics appended, a small network on top.

Vectors come from any table (a language model's, or others); nothing here runs such a model. The network (two hidden layers,
ReLU, sigmoid at the end) is trained from a replay buffer in numpy by Adam with clipped gradients.
"""

from __future__ import annotations

import random
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_at, subword_ids, truncated


def attribute_ids(attrs: list[str]) -> dict[str, int]:
    return {a: i for i, a in enumerate(attrs)}


def tokenized(entities: DataFrame, terms: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """What `prepare` takes, (id, sequence) and (id, keyword, pattern), by the tokenizer file at `path`.

    entities: (id, text), terms: (id, keyword). A term's pattern is that of a word after a space; each keyword is encoded once.
    """
    patterns = terms.select("keyword").distinct().withColumn("pattern", subword_ids(F.col("keyword"), path))
    return entities.select("id", subword_ids(F.col("text"), path).alias("sequence")), terms.select("id", "keyword").join(patterns, "keyword").select("id", "keyword", "pattern")


def prepare(entities: DataFrame, terms: DataFrame, most: int = 4094, prefix: int = 0) -> DataFrame:
    """(id, keyword, positions): where a term's sub-words are in an entity's sub-word sequence. Terms that aren't found go.

    entities: (id, sequence array<int>), terms: (id, keyword, pattern array<int>); sequences are cut to what a model takes.
    """
    rows = terms.join(entities.select("id", truncated(F.col("sequence"), most, prefix).alias("sequence")), "id")
    starts = matches_at(F.col("sequence"), F.col("pattern"))
    spread = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(0), F.size("pattern") - 1), lambda i: s + i)))
    return rows.select("id", "keyword", F.array_distinct(spread).alias("positions")).filter(F.size("positions") > 0)


def mean_pool(vectors: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, keyword, vector): the mean of the sub-word vectors (id, pos, vector) at a term's positions."""
    at = positions.select("id", "keyword", F.explode("positions").alias("pos")).join(vectors, ["id", "pos"])
    cells = at.select("id", "keyword", F.posexplode("vector").alias("i", "v")).groupBy("id", "keyword", "i").agg(F.avg("v").alias("v"))
    return cells.groupBy("id", "keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vector"))


@dataclass
class Network:
    """Layers of a multi-layer perceptron with one sigmoid output, and Adam's state."""

    sizes: tuple[int, ...]
    rate: float = 0.001
    seed: int = 0
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: int = 0

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        dims = [*self.sizes, 1]
        self.layers = [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(dims, dims[1:], strict=False)]
        self._m = [np.zeros_like(p) for layer in self.layers for p in layer]
        self._v = [np.zeros_like(p) for layer in self.layers for p in layer]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))) if i == len(self.layers) - 1 else np.maximum(z, 0))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1][:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean squared error and its gradient."""
        out = self.forward(x)
        p = out[-1][:, 0]
        back = (2 * (p - y) / len(y) * p * (1 - p))[:, None]
        grads: list[np.ndarray] = []
        for i in range(len(self.layers) - 1, -1, -1):
            grads = [out[i].T @ back, back.sum(axis=0), *grads]
            back = (back @ self.layers[i][0].T) * (out[i] > 0)
        return float(np.mean((p - y) ** 2)), grads

    def step(self, grads: list[np.ndarray], most: float = 1.0) -> None:
        """An Adam step with gradients clipped to a norm of `most`."""
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        grads = [g * min(1.0, most / (norm + 1e-6)) for g in grads]
        self.steps += 1
        flat = [p for layer in self.layers for p in layer]
        for k, g in enumerate(grads):
            self._m[k] = 0.9 * self._m[k] + 0.1 * g
            self._v[k] = 0.999 * self._v[k] + 0.001 * g**2
            flat[k] = flat[k] - self.rate * (self._m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self._v[k] / (1 - 0.999**self.steps)) + 1e-8)
        self.layers = list(zip(flat[::2], flat[1::2], strict=True))


@dataclass
class Replay:
    """Trains a network from a buffer of samples that forgets the oldest first."""

    network: Network
    size: int = 30
    sample: int = 8
    split: bool = False
    seed: int = 0
    buffer: deque = field(default_factory=deque)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.buffer.append((np.asarray(x, float), np.asarray(y, float)))

    def values(self) -> dict:
        """Weights, what the optimizer remembers and the buffer, for JSON."""
        net = self.network
        lists = lambda arrays: [a.tolist() for a in arrays]
        return {"layers": [lists(layer) for layer in net.layers], "m": lists(net._m), "v": lists(net._v), "steps": net.steps, "buffer": [lists(part) for part in self.buffer]}

    @classmethod
    def of(cls, values: dict, rate: float, size: int, sample: int, split: bool, seed: int) -> Replay:
        """The replay whose `values` are given."""
        arrays = lambda lists: [np.array(a, float) for a in lists]
        layers = [tuple(arrays(layer)) for layer in values["layers"]]
        network = Network((layers[0][0].shape[0], *[len(b) for _, b in layers[:-1]]), rate, seed)
        network.layers, network._m, network._v, network.steps = layers, arrays(values["m"]), arrays(values["v"]), values["steps"]
        return cls(network, size, sample, split, seed, deque(tuple(arrays(part)) for part in values["buffer"]))

    def fit(self) -> float:
        """One step on a uniform sample of the buffer. split: gradients sample by sample, summed before the step."""
        draw = random.Random(f"{self.seed}/{self.network.steps}")
        chosen = draw.sample(range(len(self.buffer)), min(self.sample, len(self.buffer)))
        parts = [[i] for i in chosen] if self.split else [chosen]
        loss, grads = 0.0, None
        for part in parts:
            own, g = self.network.gradient(np.concatenate([self.buffer[i][0] for i in part]), np.concatenate([self.buffer[i][1] for i in part]))
            loss = own / len(parts)
            g = [x / len(parts) for x in g]
            grads = g if grads is None else [a + b for a, b in zip(grads, g, strict=True)]
        self.network.step(grads)
        while len(self.buffer) > self.size:
            self.buffer.popleft()
        return loss


def score_column(network: Network, x: Column) -> Column:
    """The network's scores in Arrow batches; its weights are sent along."""
    layers = network.layers

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        out = np.stack(xs.to_numpy()) if len(xs) else np.empty((0, layers[0][0].shape[0]))
        for i, (w, b) in enumerate(layers):
            z = out @ w + b
            out = 1 / (1 + np.exp(-np.clip(z, -50, 50))) if i == len(layers) - 1 else np.maximum(z, 0)
        return pd.Series(out[:, 0])

    return score(x)
