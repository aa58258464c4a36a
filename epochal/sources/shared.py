"""What driver and executors share: a folder, tables written there to cut lineage, and this package."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master gets a folder of its own where it is unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="epochal-")
        spark.sparkContext.setCheckpointDir(shared_dir.own)
    return shared_dir.own


_inside: ContextVar[str | None] = ContextVar("scratch", default=None)  # folder of the innermost open scratch block of this thread


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{_inside.get() or shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block to new paths is deleted at its end, when its result must have been written elsewhere."""
    folder = new_path(spark, "scratch")
    before = _inside.set(folder)
    try:
        yield
    finally:
        _inside.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read back. Unlike a cache it survives the loss of any executor, and
    unlike RDD checkpoints it is columnar and compressed, so later reads prune columns."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing will read it again."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if name.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/") + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that functions of its modules can be loaded there."""
    context = spark.sparkContext
    if getattr(ship, "to", None) == context.applicationId:
        return
    package = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="epochal-")) / "epochal.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(out))
    ship.to = context.applicationId
