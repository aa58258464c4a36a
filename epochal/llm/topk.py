"""Exact top-k search by a pivot-distance index.

Highest inner product becomes least distance: every vector gets one more component, so that all have the norm of the longest, and
queries get zero there. Each vector is keyed by its nearest pivot and its distance from it; sorted by that key, runs of rows with one
pivot are annuli about it. By the triangle inequality nothing in an annulus is nearer to a query than the gap between the query's
distance from the pivot and the annulus. A query sorts all annuli by this gap and expands them in waves, each WIDER times as many as
the last: after each wave its k-th best distance so far is its radius, and it stops at the first annulus whose gap exceeds that.
The waves' asks meet the annuli by a join, several packs of queries in a row, so vectors of annuli move once per wave.

Pivots are fit on a bounded sample (SAMPLE rows); every row is indexed and the result is exact whatever they are. Annuli have
ANNULUS rows, or more where there would be over MOST_ANNULI of them, so the list of their bounds, which every task gets, is bounded. In
many dimensions distances concentrate, and most annuli must be seen.

Scores are exact integers: in doubles while no inner product can reach 2**52, beyond that in 64-bit integers, and where not even those
could hold one, in Python's (then scores beyond a long count as the largest or smallest long, and all annuli are expanded).

Defined cases: vectors that are null, of another length than the commonest, or with null or non-finite components (or such as are not
finite times 256) take no part; repeated ids are rows of their own; with fewer candidates than k all are returned; ties go to smaller
ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.llm.common import materialize, table
from epochal.llm.vectors import best, matrix, runs, sample, usable

PIVOTS, SAMPLE, ANNULUS, MOST_ANNULI, PACK = 64, 4096, 512, 1 << 16, 256
#: Annuli of a query's first wave, how many times wider each wave is, and packs beside an annulus in one row.
FIRST, WIDER, ASKS = 8, 8, 8


def quantised(v: np.ndarray) -> np.ndarray:
    return np.floor(256 * v)


def fit_pivots(points: np.ndarray, count: int = PIVOTS, rounds: int = 4) -> np.ndarray:
    """Means of clusters of the sample, from points far apart."""
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    pivots = points[chosen]
    for _ in range(rounds):
        nearest = distances(points, pivots).argmin(axis=1)
        for i in np.unique(nearest):
            pivots[i] = points[nearest == i].mean(axis=0)
    return pivots


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


class Space:
    """Where distances are taken: vectors over scale, all brought to the norm (squared) of the longest by one more component."""

    def __init__(self, scale: float, longest: float, pivots: np.ndarray | None = None):
        self.scale, self.longest, self.pivots = scale, longest, pivots

    def lifted(self, v: np.ndarray) -> np.ndarray:
        v = v / self.scale
        return np.hstack([v, np.sqrt(np.maximum(self.longest - (v**2).sum(axis=1), 0))[:, None]])

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v / self.scale, np.zeros((len(v), 1))])

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row has this score, and a little more for what doubles round."""
        norm = ((q / self.scale) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(self.longest + norm - 2 * (score / self.scale / self.scale), 0)) + 1e-6 * np.sqrt(self.longest) + 1e-12


def products(q: np.ndarray, v: np.ndarray, kind: str) -> np.ndarray:
    """Inner products as whole numbers."""
    if kind == "double":
        return (q @ v.T).astype(np.int64)
    if kind == "long":
        return q.astype(np.int64) @ v.astype(np.int64).T  # sums may wrap around on the way, but not in the end
    whole = np.vectorize(int, otypes=[object])
    most = (1 << 63) - 1
    return np.array([[min(max(x, -most - 1), most) for x in row] for row in whole(q) @ whole(v).T], dtype=np.int64).reshape(len(q), len(v))


def keyed(rows: DataFrame, space: Space, query: bool) -> DataFrame:
    """pivot, distance, rid, vec_id, v (quantised, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = quantised(matrix(part.column(2)))
                from_pivots = distances(space.of_queries(v) if query else space.lifted(v), space.pivots)
                pivot = from_pivots.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(from_pivots[np.arange(len(v)), pivot]), part.column(0), part.column(1), pa.array([x.tobytes() for x in v], pa.binary())], ["pivot", "distance", "rid", "vec_id", "v"])

    return rows.select("rid", "vec_id", "v").mapInArrow(run, "pivot int, distance double, rid bigint, vec_id bigint, v binary")


def annuli(rows: DataFrame, most: int) -> DataFrame:
    """at, pivot, near, far, rids, ids, v: runs of the rows sorted by pivot and distance, which bound near and far."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (pivot, distance, rid, vec_id, v) in enumerate(runs(batches, 0, most)):
            made = [part << 32 | seq, pivot[0].as_py(), distance[0].as_py(), distance[-1].as_py(), rid.to_numpy().tobytes(), vec_id.to_numpy().tobytes(), b"".join(v.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if k == 1 else None) for k, x in enumerate(made)], ["at", "pivot", "near", "far", "rids", "ids", "v"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, "pivot", "distance", "rid").sortWithinPartitions("pivot", "distance", "rid")
    return materialize(sorted_.mapInArrow(cut, "at bigint, pivot int, near double, far double, rids binary, ids binary, v binary"), "annuli")


ASK = "at bigint, pack bigint, asks int, q_rids binary, q_ids binary, q_v binary"


def asked(packs: DataFrame, bounds: tuple[np.ndarray, ...], space: Space, begin: int, width: int) -> DataFrame:
    """For each annulus that is among a pack's queries' begin-th to begin + width-th nearest and not beyond their radius: these queries.
    packs: pack, q_rids, q_ids, q_v, kth (q_rid and k-th best score, if it has one). bounds: at, pivot, near and far of all annuli."""
    shared = packs.sparkSession.sparkContext.broadcast((bounds, space))  # MOST_ANNULI rows and a few

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ats, pivot, near, far), space = shared.value
        for batch in batches:
            for row in zip(*batch.columns):
                pack, q_rids, q_ids, q_v, kth = (x.as_py() for x in row)
                rids, ids = np.frombuffer(q_rids, "<i8"), np.frombuffer(q_ids, "<i8")
                v = np.frombuffer(q_v, "<f8").reshape(len(rids), -1)
                from_pivots = distances(space.of_queries(v), space.pivots)
                score = {x["q_rid"]: x["score"] for x in kth or []}
                radius = np.full(len(rids), np.inf)
                some = [i for i, x in enumerate(rids.tolist()) if x in score]
                if some:
                    radius[some] = space.radius(v[some], np.array([score[rids[i]] for i in some], dtype=float))
                wanted: dict[int, list[int]] = {}
                for i in range(len(rids)):
                    away = from_pivots[i, pivot]
                    gap = np.maximum(np.maximum(away - far, near - away), 0)
                    order = np.lexsort((away, gap))[begin : begin + width]
                    for j in order[gap[order] <= radius[i]].tolist():
                        wanted.setdefault(j, []).append(i)
                if wanted:
                    lists = list(wanted.values())
                    columns = [pa.array(ats[list(wanted)]), pa.array(np.full(len(lists), pack)), pa.array(np.array([len(x) for x in lists], np.int32))]
                    columns += [pa.array([y[x].tobytes() for x in lists], pa.binary()) for y in (rids, ids, v)]
                    yield pa.RecordBatch.from_arrays(columns, ["at", "pack", "asks", "q_rids", "q_ids", "q_v"])

    return packs.select("pack", "q_rids", "q_ids", "q_v", "kth").mapInArrow(run, ASK)


FOUND = "pack bigint, q_rid bigint, query_id bigint, rid bigint, vec_id bigint, score bigint"


def searched(pairs: DataFrame, kind: str, k: int) -> DataFrame:
    """The k best of each annulus for each query that asks. pairs: rids, ids, v, packs (array of pack, q_rids, q_ids, q_v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                rids, ids = (np.frombuffer(x.as_py(), "<i8") for x in row[:2])
                v = np.frombuffer(row[2].as_py(), "<f8").reshape(len(ids), -1)
                for ask in row[3].as_py():
                    q_rids, q_ids = np.frombuffer(ask["q_rids"], "<i8"), np.frombuffer(ask["q_ids"], "<i8")
                    scores, out = products(np.frombuffer(ask["q_v"], "<f8").reshape(len(q_ids), -1), v, kind), []
                    for i, s in enumerate(scores):
                        others = np.flatnonzero(rids != q_rids[i])
                        top = others[best(s[others], ids[others], k)]
                        top = top[np.lexsort((rids[top], ids[top], ~s[top]))[:k]]
                        out.append((np.full(len(top), ask["pack"]), np.full(len(top), q_rids[i]), np.full(len(top), q_ids[i]), rids[top], ids[top], s[top]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["pack", "q_rid", "query_id", "rid", "vec_id", "score"])

    return pairs.select("rids", "ids", "v", "packs").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, k: int, query_step: int, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows whose vec_id is divisible by query_step. report: gets the number of pairs of a
    query and an annulus, and of those that were expanded."""
    spark = vectors.sparkSession
    rows = usable(vectors, zero=True, scale=256.0).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    fit = quantised(sample(rows, SAMPLE))
    if not len(fit):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    whole = lambda x: F.floor(x * 256).cast("double")  # noqa: E731 (less than it should be only where scores pass a long)
    scale = max(1.0, float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x) * 256.0 + 1)))).first()[0]))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(whole(x) / scale, F.lit(2.0)))
    count, longest = rows.agg(F.count("*"), F.max(norm)).first()
    limit = longest * scale * scale
    kind = "double" if limit < 2.0**52 else "long" if limit < 2.0**62 else "object"
    space = Space(scale, float(longest))
    space.pivots = fit_pivots(space.lifted(fit))
    index = annuli(keyed(rows, space, query=False), max(ANNULUS, -(-count // MOST_ANNULI)))
    packs = annuli(keyed(rows.filter(F.col("vec_id") % query_step == 0), space, query=True), PACK)
    packs = packs.select(F.col("at").alias("pack"), F.col("rids").alias("q_rids"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    keys = index.select("at", "pivot", "near", "far").orderBy("at").toArrow()  # MOST_ANNULI rows, and one for each pivot and partition
    bounds = tuple(keys.column(c).to_numpy() for c in ("at", "pivot", "near", "far"))

    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
    found, begin, width, expanded = None, 0, FIRST, 0
    while begin < len(bounds[0]):
        if found is None or kind == "object":
            ask = packs.withColumn("kth", F.lit(None).cast("array<struct<q_rid:bigint,score:bigint>>"))
        else:
            kth = found.filter(F.col("rank") == k).groupBy("pack").agg(F.collect_list(F.struct("q_rid", "score")).alias("kth"))
            ask = packs.join(kth.hint("merge"), "pack", "left")
        asks = materialize(asked(ask, bounds, space, begin, width), "asks")
        number = asks.agg(F.sum("asks")).first()[0]
        if not number:
            break
        expanded += number
        nth = F.row_number().over(Window.partitionBy("at").orderBy("pack"))
        gathered = asks.withColumn("part", F.floor((nth - 1) / ASKS)).groupBy("at", "part").agg(F.collect_list(F.struct("pack", "q_rids", "q_ids", "q_v")).alias("packs"))
        new = searched(gathered.join(index.select("at", "rids", "ids", "v").hint("merge"), "at"), kind, k)
        if found is not None:
            new = new.unionByName(found.drop("rank"))
        found = materialize(new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "found")
        begin, width = begin + width, width * WIDER
    if report is not None:
        report["expanded"] = expanded
        report["pairs"] = len(bounds[0]) * rows.filter(F.col("vec_id") % query_step == 0).count()
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return found.select("query_id", "rank", "vec_id", "score")


def op10_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, query_step=50)


def op10_sql() -> str:
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
