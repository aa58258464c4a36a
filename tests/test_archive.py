"""Archives by study, and counters of running jobs."""

import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from epochal.operators import labels, windows
from epochal.sources import archive, tables
from epochal.streaming import epochs, monitor
from tests import oracle
from tests.test_streams import at, fed  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    rows = tables.periods(spark, oracle.DATA).select("study_id", "period_idx", "stage")
    archive.write_by_study(rows, "test_labels", str(folder / "labels"), 4)
    archive.write_by_study(tables.periods(spark, oracle.DATA).select("study_id", "period_idx", "value"), "test_signals", str(folder / "signals"), 4)
    yield folder, rows
    for name in ("test_labels", "test_signals", "test_again"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_no_exchange_by_study(spark, stored):
    """Runs, windows, sizes and joins by study over archives read their buckets as they lie."""
    rows = spark.table("test_labels")
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("study_id")))
    for made in (labels.run_lengths(rows, 30), windows.sliding(rows, 3, "stage"), windows.study_sizes(rows), sized, archive.joined(rows, spark.table("test_signals"))):
        assert "Exchange" not in plan(made)
        assert made.count() > 0


def test_one_file_a_bucket(stored):
    assert len(list((stored[0] / "labels").glob("*.parquet"))) == 4


def test_attached(spark, stored):
    """Another session's files are the same table."""
    folder, rows = stored
    got = archive.attached(spark, "test_again", str(folder / "labels"), 4)
    assert "Exchange" not in plan(labels.run_lengths(got, 30))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert archive.attached(spark, "test_again", str(folder / "labels"), 4).count() == rows.count()


def brute(pairs, classes):
    return [(c, sum(t == p == c for t, p in pairs), sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)) for c in range(classes)]


def test_counters_of_a_batch(spark):
    pairs = [(i % 3, i % 2) for i in range(100)] + [(None, 1), (2, None)]
    seen = Observation("run")
    monitor.counted(spark.createDataFrame(pairs, "truth int, pred int"), 3, seen).write.format("noop").mode("overwrite").save()
    assert [r[1:] for r in monitor.rows_of(0, seen.get)] == brute(pairs, 3)


def test_counters_over_triggers(spark, fed, tmp_path):  # noqa: F811
    files = [[(10 * k + j, k, "abc"[(j + k) % 3], float(j % 2), at(k, j)) for j in range(5)] for k in range(4)]
    stage = tables.label_map("event_type", {"a": 0, "b": 1, "c": 2})
    stream = fed(*files).select(stage.alias("truth"), F.col("value").cast("int").alias("pred"))
    path = str(tmp_path / "counters")
    with monitor.CounterLog(spark, "run", path) as log:
        log.awaited(monitor.counted(stream, 3, "run").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        log.awaited(epochs.events(spark, oracle.DATA).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start())
    pairs = [("abc".index(r[2]), int(r[3])) for rows in files for r in rows]
    assert sorted(map(tuple, monitor.counters(spark, path).collect())) == brute(pairs, 3)
    per = {(r.batch, r["class"]): (r.tp, r.relevant, r.selected) for r in spark.read.parquet(path).collect()}
    assert len(per) == 12 and all(per[k, c] == brute([("abc".index(r[2]), int(r[3])) for r in files[k]], 3)[c][1:] for k, c in per)
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).filter("batch = 2").write.mode("append").parquet(path + "2")  # a batch told twice
    assert sorted(map(tuple, monitor.counters(spark, path + "2").collect())) == brute(pairs, 3)
