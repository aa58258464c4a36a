"""The source and sink of signal records: ranges, pushed filters, formats, commit and abort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.sources import records
from tests.test_files import edf


def rows_of(df):
    return {(r.study_id, r.channel, r.period_idx): np.array(r.samples) for r in df.filter("error is null").collect()}


@pytest.mark.parametrize("size", [400, 1 << 20])
def test_ranges(spark, tmp_path, size):
    """One file is read by several tasks, every period once, whatever the ranges; the last period may be short."""
    data = np.arange(2 * 10 * 95).reshape(2, -1) % 1000
    (tmp_path / "a.edf").write_bytes(edf(["C3", "E1"], 10, data))
    df = records.read_periods(spark, str(tmp_path), 3, size)
    assert df.rdd.getNumPartitions() == -(-(256 * 3 + data.size * 2) // size)
    got = rows_of(df)
    assert len(got) == df.count() == 64
    for at, channel in enumerate(["C3", "E1"]):
        assert [len(got["a", channel, k]) for k in range(32)] == [30] * 31 + [20]
        assert np.allclose(np.concatenate([got["a", channel, k] for k in range(32)]), data[at] / 10, atol=1e-4)
    tasks = df.withColumn("part", F.spark_partition_id()).select("part").distinct().count()
    assert tasks == (1 if size > 4000 else tasks) and (size > 4000 or tasks > 5)


def test_periods_of_other_lengths(spark, tmp_path):
    """Periods that are no whole number of blocks, and blocks of several seconds."""
    data = np.arange(240)[None] % 900
    (tmp_path / "a.edf").write_bytes(edf(["C3"], 8, data))  # 30 blocks of a second
    for period in (1.5, 0.25, 7, 100):
        got = rows_of(records.read_periods(spark, str(tmp_path), period, 64))
        joined = np.concatenate([got["a", "C3", k] for k in range(len(got))])
        assert np.allclose(joined, data[0] / 10, atol=1e-4) and len(got["a", "C3", 0]) == min(240, int(8 * period))


def test_filters_reach_the_reader(spark, tmp_path):
    data = np.arange(2 * 10 * 60).reshape(2, -1) % 1000
    (tmp_path / "a.edf").write_bytes(edf(["C3", "E1"], 10, data))
    df = records.read_periods(spark, str(tmp_path), 3)
    some = df.filter("channel = 'E1' and period_idx >= 4 and period_idx < 6")
    assert sorted(rows_of(some)) == [("a", "E1", 4), ("a", "E1", 5)]
    reader = records.RecordReader({"path": str(tmp_path), "period": "3"}, False)
    list(reader.pushFilters([records.EqualTo(("channel",), "E1"), records.GreaterThanOrEqual(("period_idx",), 4), records.LessThan(("period_idx",), 6)]))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 2


class Counting:
    """A file that notes what is read of it."""

    def __init__(self, file):
        self.file, self.n = file, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, at):
        self.file.seek(at)

    def read(self, n=None):
        out = self.file.read(n)
        self.n += len(out)
        return out


def test_only_what_is_needed_is_read(tmp_path, monkeypatch):
    """Headers are read alone, and a range reads the bytes of its own periods."""
    data = np.zeros((2, 10 * 3000), int)
    (tmp_path / "a.edf").write_bytes(edf(["C3", "E1"], 10, data))
    read = []

    class System:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, name):
            read.append(Counting(self.inner.open_input_file(name)))
            return read[-1]

        def __getattr__(self, name):
            return getattr(self.inner, name)

    plain = records.opened
    monkeypatch.setattr(records, "opened", lambda path: (System(plain(path)[0]), plain(path)[1]))
    headers = records.RecordReader({"path": str(tmp_path)}, True)
    assert sum(b.num_rows for p in headers.partitions() for b in headers.read(p)) == 2
    assert sum(f.n for f in read) == 256 * 3
    read.clear()
    reader = records.RecordReader({"path": str(tmp_path), "period": "30", "rangebytes": "12000"}, False)
    parts = reader.partitions()
    assert sum(b.num_rows for b in reader.read(parts[3])) == 2 * 10
    assert sum(f.n for f in read) == 256 * 3 + 10 * 30 * 10 * 2 * 2


def test_wfdb(spark, tmp_path):
    rng = np.random.default_rng(0)
    sixteen = rng.integers(-32768, 32768, (501, 2))
    sixteen.astype("<i2").tofile(tmp_path / "x.dat")
    (tmp_path / "x.hea").write_text("# a comment\nx 2 100 501 10:00:00 01/02/2003\nx.dat 16 200(0)/uV 16 0 0 0 0 EEG C3\nx.dat 16 50/mV 16 10 0 0 0 EOG\n")
    twelve = rng.integers(-2048, 2048, (501, 3))
    flat = np.append(twelve.ravel() & 0xFFF, 0).reshape(-1, 2)
    np.stack([flat[:, 0] & 255, flat[:, 0] >> 8 | flat[:, 1] >> 8 << 4, flat[:, 1] & 255], 1).astype(np.uint8).ravel()[: -(-501 * 3 * 3 // 2)].tofile(tmp_path / "y.dat")
    (tmp_path / "y.hea").write_text("y 3 50 501\n" + "".join(f"y.dat 212 100 12 0 0 0 0 S{i}\n" for i in range(3)))
    (tmp_path / "z.hea").write_text("z 1 50 501\nz.dat 80 100 12 0 0 0 0 S\n")
    df = records.read_periods(spark, str(tmp_path), 1.5, 333)
    got = rows_of(df)
    for study, channel, want in (("x", "EEG C3", sixteen[:, 0] / 200), ("x", "EOG", (sixteen[:, 1] - 10) / 50), ("y", "S0", twelve[:, 0] / 100), ("y", "S2", twelve[:, 2] / 100)):
        keys = sorted(k for k in got if k[:2] == (study, channel))
        assert np.allclose(np.concatenate([got[k] for k in keys]), want, atol=1e-3)
    assert [r.error for r in df.filter("error is not null").collect()] == ["ValueError: no WFDB format 80 here; there are 16 and 212"]
    heads = {r.channel: r for r in records.read_headers(spark, str(tmp_path)).collect()}
    assert (heads["EOG"].unit, heads["EOG"].sample_rate, heads["EOG"].n_samples, heads["S1"].sample_rate) == ("mV", 100.0, 501, 50.0)


def test_broken_files(spark, tmp_path):
    whole = edf(["C3"], 10, np.zeros((1, 600), int))
    (tmp_path / "a.edf").write_bytes(whole[:-300])
    (tmp_path / "b.edf").write_bytes(b"no edf")
    (tmp_path / "c.edf").write_bytes(b"")
    df = records.read_periods(spark, str(tmp_path), 3, 500)
    assert sorted(r.study_id for r in df.filter("error is not null").collect()) == ["a", "b", "c"]
    assert len(rows_of(df)) == 15
    assert records.read_headers(spark, str(tmp_path)).filter("error is not null").count() == 2


def frame(spark, periods=5):
    rows = [(s, c, k, [float(np.float32(np.sin(k * 8 + i) * scale)) for i in range(8)]) for s in ("s1", "s2") for c, scale in (("EEG", 3.0), ("EOG", 0.01)) for k in range(periods)]
    return spark.createDataFrame(rows, "study_id string, channel string, period_idx int, samples array<float>"), rows


def test_round_trip_keeps_headers(spark, tmp_path):
    df, rows = frame(spark)
    given = spark.createDataFrame([("s1", "EEG", "uV", "HP:0.1Hz", "p 1", "01.02.03 04.05.06"), ("s1", "EOG", None, None, None, None)], "study_id string, channel string, unit string, prefilter string, patient string, started string")
    out = str(tmp_path / "out")
    records.write_edf(df.repartition(5), out, given, 4)
    got = rows_of(records.read_periods(spark, out, 4))
    assert len(got) == len(rows)
    for s, c, k, x in rows:
        assert np.abs(got[s, c, k] - x).max() <= (6 if c == "EEG" else 0.03) / 65535
    head = {(r.study_id, r.channel): r for r in records.read_headers(spark, out).collect()}
    one = head["s1", "EEG"]
    assert (one.unit, one.prefilter, one.patient, one.started, one.sample_rate, one.n_samples) == ("uV", "HP:0.1Hz", "p 1", "01.02.03 04.05.06", 2.0, 40)
    assert head["s2", "EOG"].unit == ""
    # what a header says is written again as it is
    again = str(tmp_path / "again")
    records.write_edf(records.read_periods(spark, out, 4), again, records.read_headers(spark, out), 4)
    for name in ("s1.edf", "s2.edf"):
        assert (tmp_path / "out" / name).read_bytes() == (tmp_path / "again" / name).read_bytes()


@pytest.mark.parametrize("defect", ["period_idx = 3", "channel = 'EOG' and period_idx = 4"])
def test_failed_writes_leave_nothing(spark, tmp_path, defect):
    """A study with a gap fails the job, and no file of any study appears."""
    df, _ = frame(spark)
    out = tmp_path / "out"
    with pytest.raises(Exception, match="out of turn|lacks channel"):
        records.write_edf(df.filter(f"not (study_id = 's2' and {defect})"), str(out), df.select("study_id", "channel").distinct(), 4)
    assert not [p for p in out.rglob("*") if p.is_file()] and not list(out.glob("_attempts*"))
