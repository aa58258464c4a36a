import numpy as np
import pytest

from epochal.llm import ann, queries, topk
from tests import oracle

DATA = "/root/testdata/sf0.1/embeddings.parquet"
KIND = "vec_id long, embedding array<float>, label int, rid long, v string, pivot int"


def exact(ids, v, step, k, whole):
    asks = np.flatnonzero(ids % step == 0)
    scores = v[asks] @ v.T
    out = []
    for row, q in enumerate(asks):
        others = np.delete(np.arange(len(ids)), q)
        best = others[np.lexsort((ids[others], -scores[row, others]))[:k]]
        out += [(int(ids[q]), r + 1, int(ids[j]), int(scores[row, j]) if whole else float(scores[row, j])) for r, j in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    frame = spark.read.parquet(DATA)
    rows = frame.orderBy("vec_id").collect()
    return frame, np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float32).astype(float)


def test_recall(table):
    frame, ids, v = table
    got = ann.nearest(frame, 20, 20, block=256).collect()
    want = exact(ids, v, 20, 20, False)
    near = {(q, i): s for q, _, i, s in want}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(want) and len(near.keys() & found) >= 0.9 * len(near)
    assert all(abs(r.score - near[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in near)
    rank = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == rank.get(r.query_id, 0) + 1
        rank[r.query_id] = r.rank


def test_recall_holds_as_the_table_grows(spark):
    """Sixteen curves of three blocks of 64 rows are a quarter of this table."""
    draw = np.random.default_rng(3)
    v = draw.standard_normal((12_000, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32).astype(float)
    ids = np.arange(len(v))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").repartition(8)
    want = {(q, i) for q, _, i, _ in exact(ids, v, 100, 20, False)}
    got = {(r.query_id, r.vec_id) for r in ann.nearest(frame, 20, 100, block=64).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_doubles_stay_doubles(spark):
    draw = np.random.default_rng(5)
    v = draw.standard_normal((600, 16))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    near = {(q, i): s for q, _, i, s in exact(np.arange(600), v, 20, 20, False)}
    got = ann.nearest(frame, 20, 20).collect()
    assert len(got) == 600 and all(abs(r.score - near[r.query_id, r.vec_id]) < 1e-13 for r in got if (r.query_id, r.vec_id) in near)


def test_ties_beyond_a_block(spark):
    """More equal vectors than a block or the reach holds: any of them are nearest, by id where they are seen."""
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(900)] + [(i, [-1.0, 0.0]) for i in range(900, 1000)], "vec_id long, embedding array<float>")
    got = ann.nearest(same, 20, 300, block=64).collect()
    assert all(r.vec_id < 900 and abs(r.score - 1) < 1e-6 for r in got if r.query_id < 900) and len(got) == 80
    order = sorted(got, key=lambda r: (r.query_id, r.rank))
    assert all(a.vec_id < b.vec_id for a, b in zip(order, order[1:]) if a.query_id == b.query_id < 900 and a.score == b.score)


def whole_numbers(v, step, k):
    """By Python's integers; scores beyond a long count as the largest or smallest."""
    most = (1 << 63) - 1
    q = [[int(np.floor(256 * np.float64(x))) for x in row] for row in v]
    out = []
    for a in range(0, len(q), step):
        scored = sorted((-min(max(sum(x * y for x, y in zip(q[a], q[b])), -most - 1), most), b) for b in range(len(q)) if b != a)
        out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 9e5, 3e6])
def test_exact_with_large_components(spark, size):
    draw = np.random.default_rng(6)
    v = draw.uniform(-size, size, (1200, 20)).astype(np.float32)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, topk.top_k(frame, 5, 50).collect())) == whole_numbers(v, 50, 5)


def test_scores_beyond_a_long(spark):
    v = np.array([[1e30, 0.0], [1e30, 1.0], [-1e30, 0.0], [1.0, 1.0], [0.0, 2.0]])
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame, 4, 2).collect())) == whole_numbers(v, 2, 4)


def test_annuli_are_skipped(spark):
    """Where vectors form clusters, most annuli are never expanded, and the result is the same."""
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((40, 16)) * 10
    v = (centres[draw.integers(0, 40, 8000)] + draw.standard_normal((8000, 16)) * 0.1).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").repartition(4)
    report = {}
    got = sorted(map(tuple, topk.top_k(frame, 5, 200, report).collect()))
    assert got == exact(np.arange(8000), np.floor(256 * v.astype(float)), 200, 5, True)
    assert report["expanded"] < 0.5 * report["pairs"]


def test_blocks_in_reach(spark):
    """Blocks within reach rows of a block with queries, once each, three to a part."""
    draw, rows, begin = np.random.default_rng(4), [], 0
    for at in range(60):
        size = int(draw.integers(1, 40))
        rows.append((0, at, begin, begin + size, bytearray(b"x" if at % 3 else b"")))
        begin += size
    cut = spark.createDataFrame(rows, "curve int, at long, begin long, end long, q_ids binary")
    for reach in (7, 40, 300):
        got = [(r.at, r.q_at) for r in ann.beside(cut, reach).collect()]
        want = {(a[1], q[1]) for a in rows for q in rows if q[4] and a[3] > q[2] - reach and a[2] < q[3] + reach}
        assert len(got) == len(set(got)) and set(got) == want
        parts = ann.beside(cut, reach).groupBy("at", "part").count().collect()
        assert max(r["count"] for r in parts) <= 3


def test_hilbert_is_a_curve():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = ann.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_exact(table):
    frame, ids, v = table
    got = sorted(map(tuple, topk.top_k(frame, 5, 50).collect()))
    assert got == exact(ids, np.floor(256 * v), 50, 5, True)


@pytest.fixture
def odd(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(0, one), (20, one), (50, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, [1.0, 2.0]), (9, one), (9, one), (100, [0.5, 0.5, 0.5])]
    return spark.createDataFrame([(i, v, 0, 7, "v", 7) for i, v in rows], KIND)


def test_odd_vectors(odd):
    got = sorted(map(tuple, ann.nearest(odd, 3, 20).collect()))
    assert [r[:3] for r in got if r[0] == 0] == [(0, 1, 9), (0, 2, 9), (0, 3, 20)]  # ties go to smaller ids, repeated rows count
    assert {r[0] for r in got} == {0, 20, 100} and not {r[2] for r in got} & {3, 4, 5, 6, 7, 8}
    got = sorted(map(tuple, topk.top_k(odd, 5, 50).collect()))
    assert [r[1:] for r in got if r[0] == 0] == [(1, 9, 65536), (2, 9, 65536), (3, 20, 65536), (4, 100, 32768), (5, 4, 0)]
    assert {r[0] for r in got} == {0, 50, 100}


def test_many_equal(spark):
    same = spark.createDataFrame([(i, [0.6, 0.8], 0, 7, "v", 7) for i in range(1500)], KIND)
    got = sorted(map(tuple, topk.top_k(same, 5, 500).collect()))
    assert [r[2] for r in got if r[0] == 500] == [0, 1, 2, 3, 4]


def test_empty(odd):
    assert ann.nearest(odd.limit(0), 3, 20).count() == 0
    assert topk.top_k(odd.filter("vec_id = 3"), 3, 20).count() == 0


def test_exact_equals_sql(spark):
    con = oracle.connect()
    oracle.check(spark, con, queries.QUERIES["op10_pivots"], queries.oracle_sql()["op10_pivots"])
