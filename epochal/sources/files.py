"""Reading and writing records: signals, hypnograms, predictions and evaluations.

Text and XML formats go through Spark's own readers with declared schemas. Formats that Spark doesn't know (EDF signals and annotations,
npy and npz arrays) are read as binary files and parsed file by file in tasks; files that can't be parsed become rows of an error table.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARSE = "init_sec double, duration_sec double, stage string"
#: The study is the name of the directory that holds a file, or the file's own name.
STUDY_BY_DIR, STUDY_BY_FILE = r"([^/]+)/[^/]+$", r"([^/]+?)(?:\.[^./]+)?$"


def study_of(path, pattern: str = STUDY_BY_FILE):
    return F.regexp_extract(path, pattern, 1)


def discovered(spark: SparkSession, root: str, folder: str = ".*", file: str = ".*") -> DataFrame:
    """path, study_id of the files below root whose directory and name match. Only listings are read, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name, parent = F.regexp_extract("path", r"([^/]+)$", 1), study_of(F.col("path"), STUDY_BY_DIR)
    return files.filter(parent.rlike(f"^(?:{folder})$") & name.rlike(f"^(?:{file})$")).select("path", parent.alias("study_id"))


def paired(spark: SparkSession, root: str, folder: str = ".*", psg: str = r".*\.edf", hyp: str = r".*\.(ids|tsv|hyp|xml|np[yz])") -> DataFrame:
    """study_id, folder, psg, hyp, error: of each matching directory, the one file that matches psg and the one that matches hyp. A directory
    that holds none or several of either has an error and null paths in their place. Names that match both patterns count as psg. Directories
    of one name in different places are studies of their own, told apart by folder, the whole path."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    is_psg = name.rlike(f"^(?:{psg})$")
    is_hyp = name.rlike(f"^(?:{hyp})$") & ~is_psg
    found = discovered(spark, root, folder).groupBy("study_id", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"))
    found = found.agg(*(f(F.when(is_, F.col("path"))).alias(f"{n}{k}") for k, is_ in (("psg", is_psg), ("hyp", is_hyp)) for n, f in (("n_", F.count), ("", F.min))))
    alone = [F.when(F.col(f"n_{k}") == 1, F.col(k)).alias(k) for k in ("psg", "hyp")]
    error = F.concat_ws("; ", *(F.when(F.col(f"n_{k}") != 1, F.concat(F.col(f"n_{k}").cast("string"), F.lit(f" files match {k}"))) for k in ("psg", "hyp")))
    return found.select("study_id", "folder", *alone, F.nullif(error, F.lit("")).alias("error"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """study_id, init_sec, duration_sec, stage of .ids files (comma separated, no header)."""
    rows = spark.read.schema(SPARSE).csv(path)
    return rows.select(study_of(F.col("_metadata.file_path")).alias("study_id"), *rows.columns)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SPARSE).csv(path, sep="\t", header=True)
    return rows.select(study_of(F.col("_metadata.file_path")).alias("study_id"), *rows.columns)


def read_hyp(spark: SparkSession, path: str) -> DataFrame:
    """study_id, period_idx, stage of files with one stage per line. Each file is one row until it is cut, so lines keep places."""
    rows = spark.read.text(path, wholetext=True)
    lines = F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("period_idx", "stage")
    return rows.select(study_of(F.col("_metadata.file_path")).alias("study_id"), lines)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """study_id, init_sec, duration_sec, stage of XML files of ScoredEvent elements: those whose EventType names stages. A concept such as
    `Stage 2 sleep|2` gives the text before the bar. Events without a start or duration go."""
    rows = spark.read.format("xml").option("rowTag", "ScoredEvent").schema("EventType string, EventConcept string, Start double, Duration double").load(path)
    stages = rows.filter(F.lower("EventType").contains("stage") & F.col("Start").isNotNull() & F.col("Duration").isNotNull())
    stage = F.trim(F.regexp_extract("EventConcept", r"^([^|]*)", 1))
    return stages.select(study_of(F.col("_metadata.file_path")).alias("study_id"), F.col("Start").alias("init_sec"), F.col("Duration").alias("duration_sec"), stage.alias("stage"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """study_id, class, value of an evaluation csv, whose columns are the classes; the grand mean's row goes."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    first, *classes = rows.columns
    long = rows.filter(F.col(first) != "Grand mean").select(F.col(first).alias("study_id"), F.inline(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"`{c}`").cast("double").alias("value")) for c in classes))))
    return long.filter(F.col("value").isNotNull())


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A training log with rn, its rows' order. One small file."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    return rows.withColumn("rn", F.monotonically_increasing_id())


def parsed(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """path, error and the schema's columns for each row that parse makes of a file; one row with an error for a file that it can't
    read. parse is a small helper per file; files are spread over tasks. Spark's file sources pass over empty files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    rows = list(parse(bytes(content)))
                    out = pd.DataFrame(rows, columns=names)
                    out.insert(0, "error", None)
                except Exception as e:  # any defect of the file
                    out = pd.DataFrame({"error": [f"{type(e).__name__}: {e}"[:500]]} | {c: pd.Series([None], dtype=object) for c in names})
                out.insert(0, "path", name)
                yield out

    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, error string, {schema}")


ANNOTATIONS = "EDF Annotations"  # fixed value: the label of a channel of texts in EDF+


def edf_layout(content: bytes) -> tuple[int, int, float, list[tuple]]:
    """Header size, records, seconds a record, and per channel: label, samples a record, and the two ranges that give gain and offset."""
    text = lambda a, n: content[a : a + n].decode("ascii").strip()
    size, records, seconds, count = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))

    def fields(skip: int, width: int) -> list[str]:
        return [text(256 + count * skip + i * width, width) for i in range(count)]

    ranges = ([float(x) for x in fields(skip, 8)] for skip in (104, 112, 120, 128))
    return size, records, seconds, list(zip(fields(0, 16), map(int, fields(216, 8)), *ranges))


def parse_edf_header(content: bytes) -> Iterator[tuple[str, float, int]]:
    """channel, sample rate and number of samples. A channel of annotations is no signal."""
    _, records, seconds, channels = edf_layout(content)
    for label, n, *_ in channels:
        if label != ANNOTATIONS:
            yield label, n / seconds, n * records


def read_edf_headers(spark: SparkSession, path: str) -> DataFrame:
    """What the headers of EDF files tell; no signal leaves a task. (Spark's binary source has no way to read a file's beginning alone.)"""
    return parsed(spark, path, parse_edf_header, "channel string, sample_rate double, n_samples long")


def edf_records(content: bytes) -> Iterator[tuple[tuple, float, np.ndarray]]:
    """Each channel's layout, the seconds a record lasts, and its 16-bit samples, a record a row."""
    size, records, seconds, channels = edf_layout(content)
    per = [c[1] for c in channels]
    data = np.frombuffer(content, "<i2", count=records * sum(per), offset=size).reshape(records, sum(per))
    ends = np.cumsum(per)
    for channel, n, end in zip(channels, per, ends):
        yield channel, seconds, data[:, end - n : end]


def parse_edf(content: bytes) -> Iterator[tuple[str, float, list[float]]]:
    """channel, sample rate and samples of an EDF file: a fixed-width text header, then records of 16-bit samples per channel."""
    for (label, n, low, high, dig_low, dig_high), seconds, data in edf_records(content):
        if label != ANNOTATIONS:
            yield label, n / seconds, ((data.reshape(-1) - dig_low) * ((high - low) / (dig_high - dig_low)) + low).tolist()


def parse_edf_annotations(content: bytes) -> Iterator[tuple[float, float, str]]:
    """init_sec, duration_sec and text of the annotations of an EDF+ file: an onset, perhaps byte 21 and a duration, then texts that end in
    byte 20 each. Texts without a duration have null. The empty texts that keep the records' time go."""
    for (label, *_), _, data in edf_records(content):
        if label == ANNOTATIONS:
            for block in data.tobytes().split(b"\x00"):
                onset, *texts = block.split(b"\x14")
                if at := re.fullmatch(rb"([+-][0-9.]+)(?:\x15([0-9.]+))?", onset):
                    yield from ((float(at[1]), float(at[2]) if at[2] else None, x.decode("utf-8")) for x in texts if x)


def read_edf_annotations(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_edf_annotations, "init_sec double, duration_sec double, stage string")


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_edf, "channel string, sample_rate double, signal array<double>")


def parse_array(content: bytes) -> Iterator[tuple[int, list[float]]]:
    """idx and values of each row of an npy file, or of the first array of an npz file."""
    array = np.load(io.BytesIO(content), allow_pickle=False)
    array = array[array.files[0]] if hasattr(array, "files") else array
    for i, row in enumerate(np.atleast_1d(array)):
        yield i, np.atleast_1d(row).astype(float).ravel().tolist()


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_array, "idx int, values array<double>")


def read_stage_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, error, period_idx, stage of npy and npz files that hold one integer stage per period."""
    rows = read_arrays(spark, path)
    return rows.select("path", "error", F.col("idx").alias("period_idx"), F.col("values")[0].cast("int").alias("stage"))


def good_and_bad(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that were read, and the files that couldn't be."""
    return read.filter("error is null").drop("error"), read.filter("error is not null").select("path", "error")


def write_ids(sparse: DataFrame, path: str) -> None:
    """One directory per study; existing output is an error."""
    sparse.repartition("study_id").sortWithinPartitions("study_id", "init_sec").write.partitionBy("study_id").mode("error").csv(path)


def write_tsv(sparse: DataFrame, path: str) -> None:
    sparse.repartition("study_id").sortWithinPartitions("study_id", "init_sec").write.partitionBy("study_id").mode("error").csv(path, sep="\t", header=True)


def write_hyp(periods: DataFrame, path: str) -> None:
    rows = periods.repartition("study_id").sortWithinPartitions("study_id", "period_idx")
    rows.select("study_id", F.col("stage").cast("string").alias("value")).write.partitionBy("study_id").mode("error").text(path)


def write_archive(signals: DataFrame, path: str) -> None:
    """Signals by dataset and split, which later reads prune."""
    signals.write.partitionBy("dataset", "split").mode("error").parquet(path)


def read_archive(spark: SparkSession, path: str, datasets: list[str] | None = None, splits: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("dataset").isin(datasets)) if datasets else rows
    return rows.filter(F.col("split").isin(splits)) if splits else rows


def write_evaluation(per: DataFrame, path: str, digits: int | None = None) -> None:
    """Studies as rows and classes as columns; with digits, rounded. per: study_id, class, value."""
    value = F.round("value", digits) if digits is not None else F.col("value")
    wide = per.withColumn("value", value).groupBy("study_id").pivot("class").agg(F.first("value")).orderBy("study_id")
    wide.coalesce(1).write.mode("error").csv(path, header=True)


def write_evaluation_text(per: DataFrame, path: str, digits: int = 4, width: int = 12) -> None:
    """The same as lines of text, rounded, in columns of at least that width. Only as many lines as studies."""
    classes = sorted(r[0] for r in per.select("class").distinct().collect())  # a handful
    wide = per.groupBy("study_id").pivot("class", classes).agg(F.first("value")).orderBy("study_id")
    shown = [F.when(F.col(f"`{c}`").isNull(), "NaN").otherwise(F.format_string(f"%.{digits}f", F.round(F.col(f"`{c}`"), digits))) for c in classes]
    pad = lambda c, n: F.lpad(c, n, " ")
    cells = F.concat(F.rpad("study_id", 24, " "), *(pad(v, max(width, len(c) + 1)) for v, c in zip(shown, classes)))
    head = " " * 24 + "".join(c.rjust(max(width, len(c) + 1)) for c in classes)
    lines = wide.select(F.lit(1).alias("part"), F.col("study_id").alias("k"), F.when(F.length("study_id") > 24, F.concat("study_id", F.substr(cells, F.lit(25)))).otherwise(cells).alias("value"))
    title = per.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("k"), F.lit(head).alias("value"))
    title.unionByName(lines.withColumn("k", F.col("k").cast("string"))).coalesce(1).sortWithinPartitions("part", "k").select("value").write.mode("error").text(path)


def encoded_arrays(periods: DataFrame, columns: list[str], kind: str = "npy", by: str = "study_id", order: str = "period_idx") -> DataFrame:
    """study_id and the bytes of one npy or npz file per study: npy holds the columns side by side, npz each column under its name.
    A column is a number or an array of numbers per period. One study's periods make one group, as they make one file."""
    if kind not in ("npy", "npz"):
        raise ValueError(f"no array format named {kind}; there are npy, npz")

    def encode(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values(order), io.BytesIO()
        arrays = {c: np.array(frame[c].tolist()).reshape(len(frame), -1) for c in columns}
        np.save(out, np.concatenate(list(arrays.values()), axis=1)) if kind == "npy" else np.savez(out, **arrays)
        return pd.DataFrame({by: [str(key[0])], "content": [out.getvalue()]})

    return periods.select(by, order, *columns).groupBy(by).applyInPandas(encode, f"{by} string, content binary")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which is local or a URI that pyarrow knows (file, hdfs, s3, gs), and its name there."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def write_arrays(periods: DataFrame, path: str, columns: list[str], kind: str = "npy") -> None:
    """One <study_id>.npy or .npz per study below path, a folder that executors share or a URI. Files appear whole under their names, so tasks
    can run again and beside one another; existing output is an error."""
    system, folder = opened(path)
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(folder, recursive=True)

    def write_rows(rows) -> None:
        system, folder = opened(path)
        for row in rows:
            name = f"{folder}/{row.study_id}.{kind}"
            part = f"{folder}/.{row.study_id}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as file:
                file.write(row.content)
            if system.get_file_info(name).type == fs.FileType.NotFound:
                system.move(part, name)
            else:  # another attempt was faster, with the same content
                system.delete_file(part)

    encoded_arrays(periods, columns, kind).foreachPartition(write_rows)


WRITERS = {"ids": write_ids, "tsv": write_tsv, "hyp": write_hyp, "npy": lambda df, path: write_arrays(df, path, ["stage"]), "npz": lambda df, path: write_arrays(df, path, ["stage"], "npz"), "parquet": lambda df, path: df.write.mode("error").parquet(path)}


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind not in WRITERS:
        raise ValueError(f"no format named {kind}; there are {', '.join(sorted(WRITERS))}")
    WRITERS[kind](df, path)
