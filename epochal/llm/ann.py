"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random to a few dimensions, shifted and quantised, and get a key along a Hilbert curve; several
projections and shifts give several orderings. Spark range-partitions each ordering by key and cuts it into blocks of neighbours.
A query looks at the rows within its reach on either side of it on every curve, in its own block and those beside it; the blocks'
best candidates merge and are ranked by the exact inner product.

The scales of the quantisation are fit on a bounded sample (SAMPLE rows); every row is indexed. Recall is measured against brute
force in the tests. Isotropic vectors of many dimensions have no short cut, so the reach is a share (REACH) of the counted rows, and
at least BLOCK: recall holds as the table grows, and work grows with queries times rows, as in brute force, but many narrow curves
see less than few wide ones for the same recall: 0.8 of the rows over all curves, repeats included. What a task holds at once is
bounded: blocks are twice as wide as the reach, up to LARGEST rows, beyond which more blocks are in reach. Components keep their
precision: bytes of floats where the column has floats, of doubles otherwise.

Defined cases: vectors that are null, zero, of another length than the commonest, or with null or non-finite components take no
part; repeated ids are rows of their own; with fewer candidates than k all found are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.llm.common import materialize, table
from epochal.llm.vectors import best, matrix, runs, sample, stored, usable

CURVES, DIMS, BITS, BLOCK, SAMPLE = 32, 10, 6, 256, 8192
#: Of the table's rows, the share that a query sees on either side of it on a curve; the least and most rows of a block; query blocks
#: beside a block in one row, and queries scored at once.
REACH, SMALLEST, LARGEST, ASKS, TOGETHER = 0.0125, 1024, 16384, 3, 16


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of integer points, by Skilling's transposition: undo the turns of each level, Gray-decode,
    and interleave."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(n):
            turn = (x[i] & level) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = top
    while level > 1:
        flip ^= np.where(x[n - 1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


class Curves:
    """The projections, shifts and scales of several curves."""

    def __init__(self, fit: np.ndarray, curves: int = CURVES, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.maps = [np.linalg.qr(draw.standard_normal((fit.shape[1], fit.shape[1])))[0][:, :DIMS] for _ in range(curves)]
        self.low, self.width = [], []
        for project in self.maps:
            at = fit @ project
            low, high = at.min(axis=0), at.max(axis=0)
            room = np.maximum(high - low, 1e-12)
            self.low.append(low - room * draw.uniform(0, 0.5, len(low)))
            self.width.append(room * 1.5)

    def keys(self, v: np.ndarray, k: int) -> np.ndarray:
        at = (v @ self.maps[k] - self.low[k]) / self.width[k]
        return hilbert(np.clip(np.floor(at * (1 << BITS)), 0, (1 << BITS) - 1))


def blocks(rows: DataFrame, curves: Curves, block: int, query_step: int, kind: str) -> DataFrame:
    """curve, at, begin, end, rids, ids, v and the same of the queries among them (q_places in the block, q_rids, q_ids,
    q_v): a row per block, which has the rows from begin to end of its curve."""
    spark, count = rows.sparkSession, len(curves.maps)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2))
            packed = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            if len(v):
                for k in range(count):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(curves.keys(v, k)), batch.column(0), batch.column(1), packed], ["curve", "key", "rid", "vec_id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (curve, key, rid, vec_id, v) in enumerate(runs(batches, 0, block)):
            rids, ids, flat = rid.to_numpy(), vec_id.to_numpy(), v.to_pylist()
            asks = np.flatnonzero(ids % query_step == 0)
            made = [curve[0].as_py(), key[0].as_py(), part << 32 | seq, rids.tobytes(), ids.tobytes(), b"".join(flat), asks.tobytes(), rids[asks].tobytes(), ids[asks].tobytes(), b"".join(flat[i] for i in asks), len(ids)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) if k not in (0,) else pa.array([x], pa.int32()) for k, x in enumerate(made)], ["curve", "key", "at", "rids", "ids", "v", "q_places", "q_rids", "q_ids", "q_v", "size"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select("rid", "vec_id", "v").mapInArrow(keyed, "curve int, key bigint, rid bigint, vec_id bigint, v binary")
    sorted_ = spread.repartitionByRange(n, "curve", "key", F.xxhash64("rid")).sortWithinPartitions("curve", "key", F.xxhash64("rid"))
    made = sorted_.mapInArrow(cut, "curve int, key bigint, at bigint, rids binary, ids binary, v binary, q_places binary, q_rids binary, q_ids binary, q_v binary, size bigint")
    made = materialize(made, "curves")
    order = Window.partitionBy("curve").orderBy("at")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = made.select("curve", "at", (end - F.col("size")).alias("begin"), end.alias("end"))
    return made.join(places, ["curve", "at"])


def beside(cut: DataFrame, reach: int) -> DataFrame:
    """curve, at, q_at, part: the blocks with queries (q_at) within reach of each block, ASKS at most in a part. Joined by cells of reach
    rows; a pair counts in the first cell that both have."""
    span = lambda low, high: F.sequence(F.floor(low / reach), F.floor((high - 1) / reach))
    low, high = F.col("begin") - reach, F.col("end") + reach
    seen = cut.select("curve", "at", "begin", "end", span(F.col("begin"), F.col("end")).alias("cells"))
    asks = cut.filter(F.length("q_ids") > 0).select("curve", F.col("at").alias("q_at"), low.alias("low"), high.alias("high"), span(low, high).alias("q_cells"))
    seen, asks = seen.withColumn("cell", F.explode("cells")), asks.withColumn("cell", F.explode("q_cells"))
    pairs = seen.join(asks, ["curve", "cell"]).filter((F.col("end") > F.col("low")) & (F.col("begin") < F.col("high")))
    pairs = pairs.filter(F.col("cell") == F.greatest(F.col("cells")[0], F.col("q_cells")[0]))
    nth = F.row_number().over(Window.partitionBy("curve", "at").orderBy("q_at"))
    return pairs.select("curve", "at", "q_at", F.floor((nth - 1) / ASKS).alias("part"))


FOUND = "q_rid bigint, query_id bigint, rid bigint, vec_id bigint, score double"


def reranked(pairs: DataFrame, k: int, kind: str, reach: int) -> DataFrame:
    """The k best of each block's rows within reach of each query beside it. pairs: begin, rids, ids, v, asks (array of q_begin, q_places,
    q_rids, q_ids, q_v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                begin = row[0].as_py()
                rids, ids, v = (np.frombuffer(x.as_py(), t) for x, t in zip(row[1:], ("<i8", "<i8", kind)))
                v = v.reshape(len(ids), -1).astype(np.float64)
                out = []
                for ask in row[4].as_py():
                    places, q_rids, q_ids, q_v = (np.frombuffer(ask[c], t) for c, t in (("q_places", "<i8"), ("q_rids", "<i8"), ("q_ids", "<i8"), ("q_v", kind)))
                    q_v = q_v.reshape(len(q_ids), -1).astype(np.float64)
                    low = np.clip(ask["q_begin"] - begin + places - reach, 0, len(ids))
                    high = np.clip(ask["q_begin"] - begin + places + reach + 1, 0, len(ids))
                    for at in range(0, len(q_ids), TOGETHER):  # in the order of their places, so their windows overlap
                        first, last = low[at], high[at : at + TOGETHER][-1]
                        scores = q_v[at : at + TOGETHER] @ v[first:last].T
                        for i, s in enumerate(scores, at):
                            seen = np.arange(low[i], high[i])
                            seen = seen[rids[low[i] : high[i]] != q_rids[i]]
                            near = seen[best(s[seen - first], ids[seen], k, 1e-9)]
                            exact = (v[near] * q_v[i]).sum(axis=1)
                            top = np.lexsort((ids[near], -exact))[:k]
                            near, exact = near[top], exact[top]
                            out.append((np.full(len(near), q_rids[i]), np.full(len(near), q_ids[i]), rids[near], ids[near], exact))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q_rid", "query_id", "rid", "vec_id", "score"])

    return pairs.select("begin", "rids", "ids", "v", "asks").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: candidates found more than once count once."""
    once = found.groupBy("q_rid", "query_id", "rid", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int, query_step: int, curves: int = CURVES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows whose vec_id is divisible by query_step. block: the least reach, in
    rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, zero=False)
    fit = sample(rows, SAMPLE)
    if not len(fit):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    reach, kind = max(block, math.ceil(REACH * rows.count())), stored(vectors)
    size = min(max(block, SMALLEST, 2 * reach), LARGEST)
    cut = blocks(rows.withColumn("vec_id", F.col("vec_id").cast("bigint")), Curves(fit, curves), size, query_step, kind)
    asks = cut.select("curve", F.col("at").alias("q_at"), F.struct(F.col("begin").alias("q_begin"), "q_places", "q_rids", "q_ids", "q_v").alias("ask"))
    asks = beside(cut, reach).join(asks, ["curve", "q_at"]).groupBy("curve", "at", "part").agg(F.collect_list("ask").alias("asks"))
    pairs = cut.select("curve", "at", "begin", "rids", "ids", "v").join(asks, ["curve", "at"])
    return ranked(reranked(pairs, k, kind, reach), k)


def op2_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, query_step=20)
