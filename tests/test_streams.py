"""Streams over several triggers, with rows that come late."""

import datetime as dt

import pytest

from epochal.streaming import epochs

KIND = "event_id long, user_id long, event_type string, value double, ts timestamp"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute, seconds=second)


@pytest.fixture
def fed(spark, tmp_path):
    """A stream that reads one file a trigger, from lists of rows. A trigger drops what is late by the watermark of the one before it."""

    def feed(*files):
        for k, rows in enumerate(files):
            folder = tmp_path / f"part{k}"
            spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(folder))
            found = next(folder.glob("*.parquet"))
            (tmp_path / "in").mkdir(exist_ok=True)
            found.rename(tmp_path / "in" / f"{k}.parquet")
        import os

        for k in range(len(files)):
            os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return feed


def test_late_rows_are_dropped(fed):
    stream = fed([(1, 1, "view", 1.0, at(0)), (2, 1, "view", 1.0, at(0, 10))], [(3, 1, "view", 1.0, at(30))], [(7, 1, "view", 1.0, at(31))], [(4, 1, "view", 1.0, at(0, 20)), (5, 1, "view", 1.0, at(30, 10))], [(6, 1, "view", 1.0, at(90))])
    got = epochs.drained(epochs.tumbling(stream, "30 seconds", "1 minute", "user_id"), "append").collect()
    start = int(at(0).timestamp())
    found = {r.start - start: r.n for r in got}
    assert found[0] == 2 and found[30 * 60] == 2  # event 4 came when its window was closed, event 5 did not


def test_repeats_across_triggers(fed):
    stream = fed([(1, 1, "view", 1.0, at(0))], [(1, 1, "view", 1.0, at(1)), (2, 1, "view", 1.0, at(1))], [(2, 1, "view", 1.0, at(2))])
    assert sorted(r.event_id for r in epochs.drained(epochs.once(stream, "event_id", "1 day").select("event_id"), "append").collect()) == [1, 2]


def test_runs_across_triggers(fed):
    kinds = ["aab", "bbb", "a", "ab", "bc"]
    files, n = [], 0
    for k, part in enumerate(kinds):
        rows = []
        for j, c in enumerate(part):
            rows.append((n, 7, c, 1.0, at(k, j)))
            n += 1
        files.append(rows[::-1])  # the order within a trigger doesn't matter
    got = sorted((r.run, r.stage, r.n) for r in epochs.drained(epochs.runs(fed(*files)), "append").collect())
    assert got == [(1, "a", 2), (2, "b", 4), (3, "a", 2), (4, "b", 2)]  # the last one is open


def test_ordered_runs(fed, spark):
    """Rows out of order within and across triggers give the runs of the batch; late rows go; idle runs close by timer and leave no state."""
    kinds = "aabbbaab" + "ccc" + "a"
    times = [0, 1, 2, 3, 4, 5, 6, 7, 60, 61, 62, 200]  # minutes; more than 30 minutes of silence ends a run
    rows = [(i, 7, k, 1.0, at(m)) for i, (k, m) in enumerate(zip(kinds, times))]
    other = [(100, 8, "x", 1.0, at(3)), (101, 8, "x", 1.0, at(5))]
    stream = fed([rows[3], rows[0], other[1]], [rows[2], rows[5], rows[1]], [rows[4], other[0], rows[7]], [rows[6], rows[9]], [rows[10], rows[8]], [(900, 7, "z", 1.0, at(64)), rows[11]], [(902, 9, "end", 1.0, at(400))], [(901, 7, "late", 1.0, at(65)), (903, 9, "end", 1.0, at(800))])
    with epochs.rocksdb(spark):
        got = epochs.drained(epochs.ordered_runs(stream, "10 minutes", 1800), "append").collect()
    found = sorted((r.user_id, (r.start - int(at(0).timestamp() * 1e6)) // 60_000_000, r.stage, r.n) for r in got)
    assert found == [(7, 0, "a", 2), (7, 2, "b", 3), (7, 5, "a", 2), (7, 7, "b", 1), (7, 60, "c", 3), (7, 64, "z", 1), (7, 200, "a", 1), (8, 3, "x", 2), (9, 400, "end", 1)]


def test_ordered_runs_bound_their_state(fed, spark, tmp_path):
    """What is done leaves the state store: only the last user's waiting row, and its timer, are there at the end."""
    files = [[(100 * k + u, 10 * k + u, "a", 1.0, at(90 * k, u)) for u in range(5)] for k in range(4)] + [[(1000, 99, "a", 1.0, at(1000))]]
    with epochs.rocksdb(spark):
        query = epochs.ordered_runs(fed(*files), "1 minute", 60).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) > kept[-1] and kept[-1] <= 4
