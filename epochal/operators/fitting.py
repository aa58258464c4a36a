"""Training as a job that can stop and go on: an epoch is a pass of partial gradients, one per task, and a table of parameters.

Parameters are named layers. Each epoch writes its layers and its loss to the shared folder, and counts once both are complete; a run
that starts again goes on after the last complete epoch and gives the same tables as one that never stopped. A model says what a
gradient is (in tasks, over batches of rows) and what an update is (on the driver, of parameters whose size the model bounds). Gradients
over integers don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Layers = dict[str, np.ndarray]


class Model(Protocol):
    def initial(self) -> Layers: ...

    def gradient(self, layers: Layers, x: np.ndarray, y: np.ndarray) -> tuple[Layers, float]:
        """Summed over the rows, with their summed loss."""

    def updated(self, layers: Layers, gradient: Layers, rows: int, epoch: int) -> Layers: ...


class Perceptron:
    """A linear scorer of integer features, updated by whole sums: exact whatever the partitions. Loss: rows that are scored wrong."""

    def __init__(self, classes: int, features: int):
        self.classes, self.features = classes, features

    def initial(self) -> Layers:
        return {"scores": np.zeros((self.classes, self.features), np.int64)}

    def gradient(self, layers: Layers, x: np.ndarray, y: np.ndarray) -> tuple[Layers, float]:
        x, y = x.astype(np.int64), y.astype(int)
        pred = (x @ layers["scores"].T).argmax(1)  # of equal scores the first
        wrong, out = pred != y, np.zeros_like(layers["scores"])
        np.add.at(out, y[wrong], x[wrong])
        np.subtract.at(out, pred[wrong], x[wrong])
        return {"scores": out}, float(wrong.sum())

    def updated(self, layers: Layers, gradient: Layers, rows: int, epoch: int) -> Layers:
        return {k: layers[k] + gradient[k] for k in layers}


class Network:
    """A hidden layer of tanh units and a softmax, by gradient descent on the cross-entropy, with a rate that falls over the epochs."""

    def __init__(self, classes: int, features: int, hidden: int = 16, rate: float = 0.5, decay: float = 0.02, seed: int = 0):
        self.classes, self.features, self.hidden, self.rate, self.decay, self.seed = classes, features, hidden, rate, decay, seed

    def initial(self) -> Layers:
        rng = np.random.default_rng(self.seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        return {"hidden": draw(self.features + 1, self.hidden), "out": draw(self.hidden + 1, self.classes)}

    def gradient(self, layers: Layers, x: np.ndarray, y: np.ndarray) -> tuple[Layers, float]:
        ones, y = np.ones((len(x), 1)), y.astype(int)
        x = np.hstack([x, ones])
        h = np.hstack([np.tanh(x @ layers["hidden"]), ones])
        s = h @ layers["out"]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
        p[np.arange(len(y)), y] -= 1
        back = (p @ layers["out"].T)[:, :-1] * (1 - h[:, :-1] ** 2)
        return {"hidden": x.T @ back, "out": h.T @ p}, float(loss)

    def updated(self, layers: Layers, gradient: Layers, rows: int, epoch: int) -> Layers:
        return {k: layers[k] - self.rate / (1 + self.decay * epoch) * gradient[k] / rows for k in layers}


PARTIAL = "layer string, at int, value double, whole long"


def summed(rows: DataFrame, model: Model, layers: Layers) -> tuple[Layers, float, int]:
    """Gradient, loss and number of rows (columns x and y). A task sums its batches and hands on one partial gradient; partial
    gradients are added by place. Integers go as integers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = {k: np.zeros_like(v) for k, v in layers.items()}, 0.0, 0
        for frame in frames:
            if len(frame):
                g, more = model.gradient(layers, np.array(frame["x"].tolist()), frame["y"].to_numpy())
                total, loss, n = {k: total[k] + g[k] for k in total}, loss + more, n + len(frame)
        if n:
            for k, v in [*total.items(), ("", np.array([loss])), (" ", np.array([n]))]:
                flat, whole = v.ravel(), np.issubdtype(v.dtype, np.integer)
                yield pd.DataFrame({"layer": k, "at": np.arange(len(flat)), "value": 0.0 if whole else flat, "whole": flat if whole else 0})

    made = rows.filter("y is not null").select("x", "y").mapInPandas(run, PARTIAL)
    found = made.groupBy("layer", "at").agg(F.sum("value").alias("value"), F.sum("whole").alias("whole")).collect()  # as many rows as parameters
    out = {k: np.zeros_like(v).ravel() for k, v in layers.items()}
    loss, n = 0.0, 0
    for r in found:
        if r.layer == "":
            loss = r.value
        elif r.layer == " ":
            n = r.whole
        else:
            out[r.layer][r.at] = r.whole if np.issubdtype(out[r.layer].dtype, np.integer) else r.value
    return {k: out[k].reshape(v.shape) for k, v in layers.items()}, loss, n


class Run:
    """A training run in a folder: one directory per epoch, of layers (layer, shape, at, value, whole) and of the loss."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def epochs(self) -> int:
        """How many are complete."""
        n = 0
        while self.exists(f"losses/epoch={n + 1}"):
            n += 1
        return n

    def layers(self, epoch: int) -> Layers:
        out: Layers = {}
        rows = self.spark.read.parquet(f"{self.folder}/layers/epoch={epoch}").collect()  # the model's parameters
        for name in {r.layer for r in rows}:
            of = sorted((r for r in rows if r.layer == name), key=lambda r: r["at"])
            values = [r.value if r.value is not None else r.whole for r in of]
            out[name] = np.array(values).reshape(of[0]["shape"])
        return out

    def write(self, epoch: int, layers: Layers, loss: float, rows: int) -> None:
        """Layers first: an epoch without its loss isn't complete, and is written again."""
        made = []
        for k, v in layers.items():
            whole = np.issubdtype(v.dtype, np.integer)
            made += [(k, list(v.shape), i, None if whole else float(x), int(x) if whole else None) for i, x in enumerate(v.ravel().tolist())]
        put = lambda df, name: df.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")
        put(self.spark.createDataFrame(made, "layer string, shape array<int>, at int, value double, whole long"), "layers")
        put(self.spark.createDataFrame([(loss, rows)], "loss double, rows long"), "losses")

    def losses(self) -> list[float]:
        """Mean loss of each complete epoch, under the parameters that it began with."""
        if not self.epochs():
            return []
        found = self.spark.read.option("basePath", f"{self.folder}/losses").parquet(*(f"{self.folder}/losses/epoch={k}" for k in range(1, self.epochs() + 1)))
        return [r.loss / max(1, r.rows) for r in found.orderBy("epoch").collect()]

    def parameters(self) -> DataFrame:
        """epoch, layer, at, value, whole: of all complete epochs."""
        paths = [f"{self.folder}/layers/epoch={k}" for k in range(1, self.epochs() + 1)]
        return self.spark.read.option("basePath", f"{self.folder}/layers").parquet(*paths).select("epoch", "layer", "at", "value", "whole")


def warmed(layers: Layers, found: Layers) -> Layers:
    """layers, with those that another run has under the same name and in the same shape."""
    return {k: found[k].astype(v.dtype) if k in found and found[k].shape == v.shape else v for k, v in layers.items()}


def fit(rows: DataFrame, model: Model, folder: str, epochs: int, patience: int | None = None, warm: Run | None = None) -> Run:
    """Trains until so many epochs are complete, or until the loss hasn't fallen for patience epochs. warm: a run whose last layers to
    begin with, by name, where this run has no epoch yet. An epoch over no rows keeps the layers."""
    run = Run(rows.sparkSession, folder)
    done = run.epochs()
    layers = run.layers(done) if done else model.initial()
    if not done and warm is not None and warm.epochs():
        layers = warmed(layers, warm.layers(warm.epochs()))
    losses = run.losses()
    for epoch in range(done + 1, epochs + 1):
        if patience is not None and len(losses) > patience and min(losses[-patience:]) >= min(losses[:-patience]):
            break
        gradient, loss, n = summed(rows, model, layers)
        layers = model.updated(layers, gradient, n, epoch) if n else layers
        run.write(epoch, layers, loss, n)
        losses.append(loss / max(1, n))
    return run
