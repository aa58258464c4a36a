"""Formats: what is written is read back, and what can't be read is told."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import labels
from epochal.sources import files, tables
from tests import oracle


def test_round_trips(spark, tmp_path):
    sparse = tables.sparse(spark, oracle.DATA).filter("study_id < 5")
    want = sorted((r.init_sec, r.duration_sec, str(r.stage)) for r in sparse.collect())
    files.write(sparse, str(tmp_path / "ids"), "ids")
    files.write(sparse, str(tmp_path / "tsv"), "tsv")
    for got in (files.read_ids(spark, str(tmp_path / "ids")), files.read_tsv(spark, str(tmp_path / "tsv"))):
        assert sorted((int(r.init_sec), int(r.duration_sec), r.stage) for r in got.collect()) == want
    dense = labels.densified(sparse, 30)
    files.write(dense, str(tmp_path / "hyp"), "hyp")
    got = files.read_hyp(spark, str(tmp_path / "hyp" / "study_id=1")).orderBy("period_idx").collect()
    assert [r.stage for r in got] == [str(r.stage) for r in dense.filter("study_id = 1").orderBy("period_idx").collect()]


def test_archive_prunes(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "concat('d', id % 2) as dataset", "if(id < 10, 'train', 'val') as split")
    files.write_archive(rows, str(tmp_path / "a"))
    got = files.read_archive(spark, str(tmp_path / "a"), ["d1"], ["val"])
    assert sorted(r.id for r in got.collect()) == [11, 13, 15, 17, 19]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dataset#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def edf(labels_, rate, data):
    """A small EDF file of one-second records."""
    n, records = len(labels_), data.shape[1] // rate
    pad = lambda s, w: str(s).ljust(w).encode()
    head = pad(0, 8) + pad("x", 80) + pad("x", 80) + pad("01.01.01", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(1, 8) + pad(n, 4)
    for values, width in ((labels_, 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-1000] * n, 8), ([1000] * n, 8), ([""] * n, 80), ([rate] * n, 8), ([""] * n, 32)):
        head += b"".join(pad(v, width) for v in values)
    body = b"".join(data[c, r * rate : (r + 1) * rate].astype("<i2").tobytes() for r in range(records) for c in range(n))
    return head + body


def test_edf_and_errors(spark, tmp_path):
    data = np.arange(40).reshape(2, 20) * 10
    (tmp_path / "a.edf").write_bytes(edf(["C3", "E1"], 10, data))
    (tmp_path / "b.edf").write_bytes(b"no edf at all")
    good, bad = files.good_and_bad(files.read_edf(spark, str(tmp_path)))
    got = {r.channel: r for r in good.collect()}
    assert got["C3"].sample_rate == 10
    assert np.allclose(got["E1"].signal, data[1] / 10)
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["b.edf"]


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.array([[1, 2], [3, 4]]))
    out = io.BytesIO()
    np.savez(out, np.array([7, 8, 9]))
    (tmp_path / "y.npz").write_bytes(out.getvalue())
    good, bad = files.good_and_bad(files.read_arrays(spark, str(tmp_path)))
    assert bad.count() == 0
    assert sorted((r.path[-1], r.idx, r["values"]) for r in good.collect()) == [("y", 0, [1.0, 2.0]), ("y", 1, [3.0, 4.0]), ("z", 0, [7.0]), ("z", 1, [8.0]), ("z", 2, [9.0])]


def test_evaluation(spark, tmp_path):
    per = spark.createDataFrame([("a", "mean", 0.51234), ("a", "cls 0", 1.0), ("b", "mean", 0.25)], "study_id string, class string, value double")
    files.write_evaluation(per, str(tmp_path / "e"), 2)
    got = sorted(map(tuple, files.read_evaluation(spark, str(tmp_path / "e")).collect()))
    assert got == [("a", "cls 0", 1.0), ("a", "mean", 0.51), ("b", "mean", 0.25)]


def test_discovery(spark, tmp_path):
    for study, name in (("s1", "psg.edf"), ("s1", "hyp.ids"), ("t2", "psg.edf")):
        (tmp_path / study).mkdir(exist_ok=True)
        (tmp_path / study / name).write_bytes(b"x")
    got = files.discovered(spark, str(tmp_path), folder=r"s\d", file=r"psg\..*").collect()
    assert [r.study_id for r in got] == ["s1"]


def test_headers_and_annotations(spark, tmp_path):
    texts = b"+0\x14\x14\x00+0\x1530\x14Sleep stage W\x14\x00+30\x1560.5\x14Sleep stage 2\x14\x00+7\x14note\x14\x00".ljust(160, b"\x00")
    data = np.stack([np.arange(80), np.frombuffer(texts, "<i2")])
    (tmp_path / "a.edf").write_bytes(edf(["C3", "EDF Annotations"], 80, data))
    (tmp_path / "b.edf").write_bytes(b"0")
    good, bad = files.good_and_bad(files.read_edf_headers(spark, str(tmp_path)))
    assert [(r.channel, r.sample_rate, r.n_samples) for r in good.collect()] == [("C3", 80.0, 80)]
    assert bad.count() == 1
    assert [r.channel for r in files.good_and_bad(files.read_edf(spark, str(tmp_path)))[0].collect()] == ["C3"]
    good, _ = files.good_and_bad(files.read_edf_annotations(spark, str(tmp_path)))
    assert sorted((r.init_sec, r.duration_sec, r.stage) for r in good.collect()) == [(0.0, 30.0, "Sleep stage W"), (7.0, None, "note"), (30.0, 60.5, "Sleep stage 2")]


def test_xml(spark, tmp_path):
    event = "<ScoredEvent><EventType>{}</EventType><EventConcept>{}</EventConcept><Start>{}</Start><Duration>{}</Duration></ScoredEvent>"
    events = event.format("Stages|Stages", "Wake|0", 0, 60) + event.format("Respiratory|R", "Hypopnea|H", 5, 11.5) + event.format("Stages|Stages", "Stage 2 sleep|2", 60, 30)
    (tmp_path / "s1.xml").write_text(f"<PSGAnnotation><ScoredEvents>{events}</ScoredEvents></PSGAnnotation>")
    assert sorted(map(tuple, files.read_xml(spark, str(tmp_path)).collect())) == [("s1", 0.0, 60.0, "Wake"), ("s1", 60.0, 30.0, "Stage 2 sleep")]


def test_pairs(spark, tmp_path):
    for study, name in (("s1", "a.edf"), ("s1", "a.ids"), ("s2", "b.edf"), ("s3", "c.edf"), ("s3", "d.edf"), ("s3", "c.ids"), ("t1", "e.edf")):
        (tmp_path / study).mkdir(exist_ok=True)
        (tmp_path / study / name).write_bytes(b"x")
    got = {r.study_id: (r.psg and r.psg[-5:], r.hyp and r.hyp[-5:], r.error) for r in files.paired(spark, str(tmp_path), r"s\d").collect()}
    assert got == {"s1": ("a.edf", "a.ids", None), "s2": ("b.edf", None, "0 files match hyp"), "s3": (None, "c.ids", "2 files match psg")}


def test_pairs_of_equal_names(spark, tmp_path):
    """Studies of one name in two datasets stay two."""
    for dataset in "ab":
        (tmp_path / dataset / "S1").mkdir(parents=True)
        for name in ("x.edf", "x.ids"):
            (tmp_path / dataset / "S1" / name).write_bytes(b"x")
    got = files.paired(spark, str(tmp_path)).collect()
    assert sorted((r.study_id, r.folder[-4:], r.psg[-10:], r.hyp[-10:], r.error) for r in got) == [("S1", f"{d}/S1", f"{d}/S1/x.edf", f"{d}/S1/x.ids", None) for d in "ab"]


def test_array_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2, [0.5, 0.25]), ("a", 0, 1, [1.0, 0.0]), ("b", 0, 4, [0.0, 1.0])], "study_id string, period_idx int, stage int, scores array<double>")
    files.write(rows, str(tmp_path / "npy"), "npy")
    good, bad = files.good_and_bad(files.read_stage_arrays(spark, str(tmp_path / "npy")))
    assert bad.count() == 0
    assert sorted((r.path[-5:], r.period_idx, r.stage) for r in good.collect()) == [("a.npy", 0, 1), ("a.npy", 1, 2), ("b.npy", 0, 4)]
    files.write_arrays(rows, str(tmp_path / "npz"), ["stage", "scores"], "npz")
    assert sorted(p.name for p in (tmp_path / "npz").iterdir()) == ["a.npz", "b.npz"]
    with np.load(tmp_path / "npz" / "a.npz") as got:
        assert got["stage"].tolist() == [[1], [2]]
        assert got["scores"].tolist() == [[1.0, 0.0], [0.5, 0.25]]


def test_array_sinks_by_uri(spark, tmp_path):
    """A URI is written as a folder is; nothing but whole files stays, and existing output is an error."""
    rows = spark.range(40).select(F.format_string("s%d", F.col("id") % 8).alias("study_id"), (F.col("id") / 8).cast("int").alias("period_idx"), (F.col("id") % 5).cast("int").alias("stage"))
    files.write_arrays(rows, f"file://{tmp_path}/deep/npy", ["stage"])
    assert sorted(p.name for p in (tmp_path / "deep" / "npy").iterdir()) == [f"s{k}.npy" for k in range(8)]
    assert np.load(tmp_path / "deep" / "npy" / "s3.npy").ravel().tolist() == [k % 5 for k in range(3, 40, 8)]
    with pytest.raises(FileExistsError):
        files.write_arrays(rows, f"file://{tmp_path}/deep/npy", ["stage"])


def test_evaluation_text(spark, tmp_path):
    per = spark.createDataFrame([("a", "mean", 0.512345), ("a", "cls 0", 1.0), ("b", "mean", 0.25)], "study_id string, class string, value double")
    files.write_evaluation_text(per, str(tmp_path / "t"))
    lines = [r.value.split() for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines == [["cls", "0", "mean"], ["a", "1.0000", "0.5123"], ["b", "NaN", "0.2500"]]
