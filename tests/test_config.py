import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import export, metrics, windows
from epochal.sources import config, files, tables
from tests import oracle


def test_paths_and_merging():
    c = {"a": {"b": 1}}
    assert config.get(c, "/a/b") == 1 and config.get(c, "/a/x/y", 5) == 5
    assert config.merged(c, {"/a/b": 2, "/n/m": 3}) == {"a": {"b": 2}, "n": {"m": 3}} and c == {"a": {"b": 1}}
    assert config.put(c, "/a/b", None) == {"a": {}}


def test_migration():
    assert config.migrated({"period_length_sec": 30}) == {"period_length": 30, "time_unit": "SECOND"}
    with pytest.raises(ValueError, match="both"):
        config.migrated({"period_length_sec": 30, "period_length": 20})


def test_datasets(spark, tmp_path):
    rows = spark.range(6).selectExpr("id", "'x' as dataset", "if(id < 4, 'train', 'test') as split")
    for name in ("one", "two"):
        files.write_archive(rows, str(tmp_path / name))
        (tmp_path / f"{name}.json").write_text(json.dumps({"data_dir": str(tmp_path / name)}))
    (tmp_path / "main.json").write_text(json.dumps({"datasets": {"d1": "one.json", "d2": "two.json"}}))
    main = config.load(str(tmp_path / "main.json"))
    both = config.datasets(main, str(tmp_path))
    got = config.all_splits(spark, both, ["test"]).collect()
    assert sorted((r.dataset, r.id) for r in got) == [("d1", 4), ("d1", 5), ("d2", 4), ("d2", 5)]
    assert list(config.datasets(main, str(tmp_path), ["d2"])) == ["d2"]
    with pytest.raises(ValueError, match="no datasets named"):
        config.datasets(main, str(tmp_path), ["d3"])
    config.described(str(tmp_path / "about.json"), {"a": 1})
    with pytest.raises(FileExistsError):
        config.described(str(tmp_path / "about.json"), {"a": 1})


def test_plots(spark):
    sparse = spark.createDataFrame([(1, 0, 60, 2), (1, 60, 30, 0)], "study_id long, init_sec int, duration_sec int, stage int")
    assert [(r.x, r.y) for r in export.step_points(sparse).orderBy("nth").collect()] == [(0, 2), (60, 2), (60, 0), (90, 0)]
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "truth int, pred int")
    assert [tuple(r) for r in export.heat_map(metrics.confusion(pairs, 2), [0, 1]).collect()] == [(0, 1, 1), (1, 0, 1)]
    log = spark.createDataFrame([(0, 4.0), (1, 2.0)], "epoch int, loss double")
    assert [r.smoothed for r in export.learning_curves(log, ["loss"], 2).orderBy("epoch").collect()] == [4.0, 3.0]


def test_tensors(spark):
    periods = tables.periods(spark, oracle.DATA).filter("study_id in (1, 2)").withColumn("signal", F.array(*(F.array("value", -F.col("value")) for _ in range(4))))
    made = list(export.tensors(windows.margin_windows(periods, 1, "signal", "stage"), 16))
    total = periods.count()
    assert sum(len(x) for x, _ in made) == total and all(len(x) == 16 for x, _ in made[:-1])
    assert made[0][0].shape == (16, 3, 4, 2) and made[0][1].shape == (16, 3, 1) and made[0][1].dtype == np.uint8
