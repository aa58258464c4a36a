"""Staging models: a trainable segmenter on period features, and the forward pass of a fully convolutional network.

Training runs on Spark ML; a network's weights are trained elsewhere, broadcast (they are of fixed size) and applied to one study at a
time in tasks, so a model sees whole records and tasks hold one record each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSIFIERS = {
    "logistic": lambda **kw: LogisticRegression(labelCol="stage", maxIter=kw.pop("max_iter", 20), **kw),
    "forest": lambda **kw: RandomForestClassifier(labelCol="stage", numTrees=kw.pop("trees", 20), seed=kw.pop("seed", 0), **kw),
}
FEATURES = ("value", "mean", "std", "before", "after")


def features(periods: DataFrame, around: int = 2) -> DataFrame:
    """A period's value, its neighbourhood's mean and deviation, and its neighbours' values."""
    order = Window.partitionBy("study_id").orderBy("period_idx")
    near = order.rowsBetween(-around, around)
    return periods.select(
        "study_id", "period_idx", "stage", "value", F.avg("value").over(near).alias("mean"), F.coalesce(F.stddev_pop("value").over(near), F.lit(0.0)).alias("std"),
        F.coalesce(F.lag("value").over(order), F.col("value")).alias("before"), F.coalesce(F.lead("value").over(order), F.col("value")).alias("after"),
    )


def fit(featured: DataFrame, kind: str = "logistic", **settings) -> PipelineModel:
    if kind not in CLASSIFIERS:
        raise ValueError(f"no classifier named {kind}; there are {sorted(CLASSIFIERS)}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), CLASSIFIERS[kind](**settings)]).fit(featured)


def staged(model: PipelineModel, featured: DataFrame) -> DataFrame:
    """study_id, period_idx, truth, pred."""
    return model.transform(featured).select("study_id", "period_idx", F.col("stage").alias("truth"), F.col("prediction").cast("int").alias("pred"))


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x: samples, channels; w: kernel, channels in, channels out. Same padding, the odd place behind."""
    k = len(w)
    padded = np.pad(x, (((k - 1) // 2, k // 2), (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(padded, k, axis=0).reshape(len(x), -1) @ w.transpose(1, 0, 2).reshape(-1, w.shape[2]) + b


def elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def normed(x: np.ndarray, p: dict) -> np.ndarray:
    return (x - p["mean"]) / np.sqrt(p["var"] + 1e-3) * p["gamma"] + p["beta"]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(x: np.ndarray, net: dict, per_period: int) -> np.ndarray:
    """Scores of each period. An encoder halves the rate at each block and keeps what it had; a decoder doubles it and joins the two; a
    dense head, a mean over each period, and a classifier over periods follow."""
    skips = []
    for block in net["down"]:
        x = normed(elu(conv(x, block["w"], block["b"])), block)
        x = np.pad(x, ((len(x) % 2, 0), (0, 0)))
        skips.append(x)
        x = x.reshape(-1, 2, x.shape[1]).max(axis=1)
    x = normed(elu(conv(x, net["bottom"]["w"], net["bottom"]["b"])), net["bottom"])
    for block, skip in zip(net["up"], reversed(skips)):
        x = normed(elu(conv(np.repeat(x, 2, axis=0), block["w"], block["b"])), block)[: len(skip)]
        x = normed(elu(conv(np.hstack([skip[: len(x)], x]), block["w2"], block["b2"])), block["norm2"])
    x = np.tanh(x @ net["dense"]["w"] + net["dense"]["b"])
    whole = len(x) // per_period
    x = x[: whole * per_period].reshape(whole, per_period, -1).mean(axis=1)
    return softmax(elu(conv(x, net["head"]["w"], net["head"]["b"])) @ net["out"]["w"] + net["out"]["b"])


def random_net(channels: int, classes: int, depth: int = 3, filters: int = 4, kernel: int = 5, growth: float = 2**0.5, seed: int = 0) -> dict:
    """A network of that shape with random weights."""
    draw = np.random.default_rng(seed)

    def layer(k: int, a: int, b: int) -> dict:
        return {"w": draw.normal(0, (k * a) ** -0.5, (k, a, b)), "b": np.zeros(b), "mean": np.zeros(b), "var": np.ones(b), "gamma": np.ones(b), "beta": np.zeros(b)}

    sizes, down, c = [], [], channels
    for _ in range(depth):
        down.append(layer(kernel, c, filters))
        sizes.append(c := filters)
        filters = int(filters * growth)
    net, up = {"down": down, "bottom": layer(kernel, c, filters)}, []
    c = filters
    for size in reversed(sizes):
        one, two = layer(2, c, size), layer(kernel, 2 * size, size)
        up.append(one | {"w2": two["w"], "b2": two["b"], "norm2": two})
        c = size
    dense = lambda a, b: {"w": draw.normal(0, a**-0.5, (a, b)), "b": np.zeros(b)}
    return net | {"up": up, "dense": dense(c, c), "head": layer(1, c, classes), "out": dense(classes, classes)}


def scored(records: DataFrame, key: str, channels: list[str], net: dict, per_period: int) -> DataFrame:
    """key, period_idx, scores: each record (array columns) in one pass."""
    shared = records.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                scores = forward(np.stack([np.asarray(c, dtype=float) for c in row[1:]], axis=1), shared.value, per_period)
                yield pd.DataFrame({key: row[0], "period_idx": np.arange(len(scores), dtype=np.int32), "scores": list(scores)})

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, *channels).mapInPandas(run, f"{key} {kind}, period_idx int, scores array<double>")
