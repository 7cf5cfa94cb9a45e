"""A trained encoder for link prediction: features and the mean of the neighbours' features, each times a matrix, added and rectified.

Trained on the driver over at most EDGES edges by binary cross-entropy on ten times the cosine of the ends, Adam, with early stop on the area under the curve of
held-out edges, once for each of SEEDS; the vectors of the seeds are concatenated, so that a cosine is the mean over them. Vertices are encoded in batches on
the executors; vertices that were not in training, as those of a query graph, are encoded in the same way from their features and neighbours.

Defined results: vertices without neighbours have a mean of zeros; an edge whose end has no features is left out; without edges the weights stay as drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.vectors import link_split, mean_neighbours, negatives

#: Edges that are trained on at most, the first by hash; and the seeds of the ensemble.
EDGES, SEEDS = 20_000, (0, 1, 2, 3, 4)
HIDDEN, RATE, DECAY, EPOCHS, PATIENCE = 64, 5e-3, 5e-4, 300, 30


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the curve by ranks; ties count half."""
    _, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    pos = label == 1
    k, m = pos.sum(), (~pos).sum()
    return float((rank[pos].sum() - k * (k + 1) / 2) / (k * m)) if k and m else 0.5


class Encoder:
    """x -> relu(x w + mean u), to unit length; leaky, so that no vector is all zeros."""

    def __init__(self, dim: int, hidden: int = HIDDEN, seed: int = 0):
        rnd = np.random.default_rng(seed)
        self.rnd, self.p = rnd, [rnd.normal(0, dim**-0.5, (dim, hidden)) for _ in range(2)]

    def encode(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        h = x @ self.p[0] + m @ self.p[1]
        z = np.where(h > 0, h, 0.2 * h)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def _step(self, x: np.ndarray, m: np.ndarray, src: np.ndarray, dst: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        h = x @ self.p[0] + m @ self.p[1]
        z = np.where(h > 0, h, 0.2 * h)
        n = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        e = z / n
        cos = (e[src] * e[dst]).sum(1)
        g = 10 * (1 / (1 + np.exp(-10 * cos)) - label) / len(label)
        de = np.zeros_like(e)
        np.add.at(de, src, g[:, None] * e[dst])
        np.add.at(de, dst, g[:, None] * e[src])
        dz = (de - e * (e * de).sum(1, keepdims=True)) / n
        dh = np.where(h > 0, dz, 0.2 * dz)
        return [x.T @ dh + DECAY * self.p[0], m.T @ dh + DECAY * self.p[1]]

    def fit(self, x: np.ndarray, m: np.ndarray, train: np.ndarray, valid: tuple[np.ndarray, np.ndarray], epochs: int = EPOCHS) -> "Encoder":
        """train: (n, 2) places of the ends of edges; valid: places and labels of held-out pairs."""
        if not len(train):
            return self
        known = {tuple(sorted(t)) for t in train.tolist()}
        a, b = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        best, kept, stale = -1.0, [p.copy() for p in self.p], 0
        for t in range(1, epochs + 1):
            # Negatives keep the source and draw another end; known edges are drawn again, and left out if they come once more.
            dst = self.rnd.integers(0, len(x), len(train))
            ok = np.array([(min(s, d), max(s, d)) not in known and s != d for s, d in zip(train[:, 0].tolist(), dst.tolist())], bool)
            src, end = np.concatenate([train[:, 0], train[ok, 0]]), np.concatenate([train[:, 1], dst[ok]])
            for i, g in enumerate(self._step(x, m, src, end, np.concatenate([np.ones(len(train)), np.zeros(ok.sum())]))):
                a[i], b[i] = 0.9 * a[i] + 0.1 * g, 0.999 * b[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (a[i] / (1 - 0.9**t)) / (np.sqrt(b[i] / (1 - 0.999**t)) + 1e-8)
            e = self.encode(x, m)
            now = auc((e[valid[0][:, 0]] * e[valid[0][:, 1]]).sum(1), valid[1]) if len(valid[1]) else -1.0 / t
            if now > best + 1e-4:
                best, kept, stale = now, [p.copy() for p in self.p], 0
            else:
                stale += 1
                if stale >= PATIENCE:
                    break
        self.p = kept
        return self


def train(features: DataFrame, edges: DataFrame, seeds: tuple[int, ...] = SEEDS, hidden: int = HIDDEN) -> list[Encoder]:
    """An encoder a seed, from the training part of the edges; features: (name, x)."""
    parts = link_split(edges).filter("part <> 'test'")
    few = parts.orderBy(F.xxhash64("src", "dst"), "src", "dst").limit(EDGES)
    fitted = few.filter("part = 'train'").select("src", "dst")
    wrong = negatives(few.filter("part = 'valid'").select("src", "dst"), features.select("name"))
    rows = few.withColumn("label", F.lit(1)).select("src", "dst", "part", "label").unionByName(wrong.withColumn("part", F.lit("valid")).withColumn("label", F.lit(0))).collect()
    names = sorted({n for r in rows for n in (r.src, r.dst)})
    wanted = features.sparkSession.createDataFrame([(n,) for n in names], "name string")
    table = {r.name: (r.x, r.m) for r in features.join(mean_neighbours(features, fitted).withColumnRenamed("x", "m"), "name").join(wanted, "name", "left_semi").collect()}
    names = [n for n in names if n in table]
    at = {n: i for i, n in enumerate(names)}
    rows = sorted((at[r.src], at[r.dst], r.part, r.label) for r in rows if r.src in at and r.dst in at)
    dim = len(one.x) if (one := features.select("x").first()) else 1
    x, m = (np.array([table[n][i] for n in names], float).reshape(-1, dim) for i in (0, 1))
    train_ = np.array([r[:2] for r in rows if r[2] == "train"], int).reshape(-1, 2)
    held = [r for r in rows if r[2] == "valid"]
    valid = np.array([r[:2] for r in held], int).reshape(-1, 2), np.array([r[3] for r in held], int)
    return [Encoder(dim, hidden, s).fit(x, m, train_, valid) for s in seeds]


def encode(features: DataFrame, edges: DataFrame, encoders: list[Encoder]) -> DataFrame:
    """(name, x): vectors of all vertices under all encoders, concatenated to unit length; the vertices need not have been in training."""
    held = features.sparkSession.sparkContext.broadcast(encoders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, m = np.stack(b.x.to_numpy()).astype(float), np.stack(b.m.to_numpy()).astype(float)
                z = np.concatenate([e.encode(x, m) for e in held.value], axis=1) / len(held.value) ** 0.5
                yield pd.DataFrame({"name": b["name"], "x": list(z)})

    near = mean_neighbours(features, edges).withColumnRenamed("x", "m")
    return features.select("name", "x").join(near, "name").mapInPandas(run, "name string, x array<double>")
