"""Signal records as a data source of Spark: EDF and WFDB files (formats 16 and 212), read in ranges of bytes and written whole or not at all.

A file is cut into ranges, a task each, as Spark cuts text files. A task reads the file's header, and then only the bytes of the periods
that begin in its range, of the channels asked for. A row is one period of one channel. Filters on channel and period_idx reach the
reader. Headers alone are a source of their own, which reads no signal. Files are reached through pyarrow's file systems, so a path is a
local folder that all machines share, or a URI that pyarrow knows (file, hdfs, s3, gs).

A file that can't be read becomes one row with an error, as does a range of it that can't. The last period of a record may be short.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from epochal.sources.files import ANNOTATIONS, opened

PERIODS = "path string, study_id string, channel string, sample_rate double, period_idx long, samples array<float>, error string"
HEADERS = """path string, study_id string, channel string, sample_rate double, n_samples long, unit string, prefilter string, transducer string,
phys_min double, phys_max double, dig_min long, dig_max long, patient string, recording string, started string, error string"""
#: Bytes of a range; those of a file's name that aren't its study.
RANGE, SUFFIX = 16 << 20, re.compile(r"\.(edf|hea|dat)$", re.IGNORECASE)


@dataclass
class Channel:
    """A channel's header. Samples are stored as (x - phys_min) scaled from dig_min to dig_max; per: samples a block."""

    label: str
    per: int
    unit: str = ""
    prefilter: str = ""
    transducer: str = ""
    phys_min: float = -1.0
    phys_max: float = 1.0
    dig_min: int = -32768
    dig_max: int = 32767

    def physical(self, stored: np.ndarray) -> np.ndarray:
        return ((stored.astype(np.float64) - self.dig_min) * ((self.phys_max - self.phys_min) / (self.dig_max - self.dig_min)) + self.phys_min).astype(np.float32)

    def stored(self, x: np.ndarray) -> np.ndarray:
        scaled = (x.astype(np.float64) - self.phys_min) * ((self.dig_max - self.dig_min) / (self.phys_max - self.phys_min)) + self.dig_min
        return np.clip(np.floor(scaled + 0.5), self.dig_min, self.dig_max).astype("<i2")


@dataclass
class Layout:
    """Blocks of so many seconds, each with all channels one after the other (interleaved: sample by sample), from a byte on."""

    channels: list[Channel]
    seconds: float
    blocks: int
    begin: int = 0
    bits: int = 16
    interleaved: bool = False
    patient: str = ""
    recording: str = ""
    started: str = ""

    @property
    def per_block(self) -> int:
        return sum(c.per for c in self.channels)

    def byte_of(self, block: int) -> int:
        """Where a block begins. With 12 bits two samples share three bytes, so an odd sample begins inside of them."""
        return self.begin + block * self.per_block * self.bits // 8

    def stored(self, file: pa.NativeFile, first: int, last: int) -> np.ndarray:
        """The stored numbers of blocks first to last - 1, a block a row."""
        a, b = first * self.per_block, last * self.per_block
        if self.bits == 16:
            file.seek(self.begin + 2 * a)
            flat = np.frombuffer(file.read(2 * (b - a)), "<i2")
        else:
            file.seek(self.begin + a // 2 * 3)
            raw = np.frombuffer(file.read(-(-b // 2) * 3 - a // 2 * 3), np.uint8).astype(np.int16)
            raw = np.concatenate([raw, np.zeros(-len(raw) % 3, np.int16)]).reshape(-1, 3)  # an odd last sample has two bytes
            pair = np.stack([raw[:, 0] | (raw[:, 1] & 15) << 8, raw[:, 2] | (raw[:, 1] >> 4) << 8], 1)
            flat = np.where(pair > 2047, pair - 4096, pair).ravel()[a % 2 : a % 2 + b - a]
        if len(flat) < b - a:
            raise ValueError(f"the file ends inside of block {first + len(flat) // self.per_block} of {self.blocks}")
        return flat.reshape(last - first, self.per_block)

    def of_channel(self, stored: np.ndarray, at: int) -> np.ndarray:
        if self.interleaved:
            return stored.reshape(len(stored), -1, len(self.channels))[:, :, at].ravel()
        begin = sum(c.per for c in self.channels[:at])
        return stored[:, begin : begin + self.channels[at].per].ravel()


def edf_layout(file: pa.NativeFile, size: int) -> Layout:
    head = file.read(256)
    text = lambda a, n: head[a : a + n].decode("latin-1").strip()
    begin, blocks, seconds, n = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    head += file.read(256 * n)

    def field(skip: int, width: int) -> list[str]:
        return [text(256 + n * skip + i * width, width) for i in range(n)]

    rows = zip(field(0, 16), field(216, 8), field(96, 8), field(136, 80), field(16, 80), field(104, 8), field(112, 8), field(120, 8), field(128, 8))
    channels = [Channel(a, int(per), unit, pre, trans, float(lo), float(hi), int(dlo), int(dhi)) for a, per, unit, pre, trans, lo, hi, dlo, dhi in rows]
    out = Layout(channels, seconds, blocks, begin, patient=text(8, 80), recording=text(88, 80), started=f"{text(168, 8)} {text(176, 8)}")
    if blocks < 0:  # not known when the header was written
        out.blocks = (size - begin) // (2 * out.per_block)
    return out


def wfdb_layout(text: str) -> tuple[str, Layout]:
    """Name of the signal file, and its layout with a frame as a block. One signal file of format 16 or 212 a record."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    n, rate, frames = int(lines[0][1]), float(lines[0][2].split("/")[0].split("(")[0]), int(lines[0][3])
    channels, names, formats = [], set(), set()
    for line in lines[1 : n + 1]:
        kind = re.fullmatch(r"(16|212)(?:\+(\d+))?", line[1])
        if not kind:
            raise ValueError(f"no WFDB format {line[1]} here; there are 16 and 212")
        gain = re.fullmatch(r"([0-9.eE+-]+?)(?:\((-?\d+)\))?(?:/(\S+))?", line[2] if len(line) > 2 else "200")
        zero, scale = int(gain[2] if gain[2] else line[4] if len(line) > 4 else 0), float(gain[1]) or 200.0
        low, high = (-32768, 32767) if kind[1] == "16" else (-2048, 2047)
        channels.append(Channel(" ".join(line[8:]), 1, gain[3] or "mV", "", "", (low - zero) / scale, (high - zero) / scale, low, high))
        names.add(line[0])
        formats.add((int(kind[1]), int(kind[2] or 0)))
    if len(names) != 1 or len(formats) != 1:
        raise ValueError("one signal file and one format a record are read")
    (kind, begin), started = formats.pop(), " ".join(lines[0][4:6])
    return names.pop(), Layout(channels, 1 / rate, frames, begin, 12 if kind == 212 else 16, True, recording=lines[0][0], started=started)


def layout_of(path: str, size: int) -> tuple[Layout, fs.FileSystem, str]:
    """A file's layout, and where its signal is."""
    system, name = opened(path)
    with system.open_input_file(name) as file:
        if not name.lower().endswith(".hea"):
            return edf_layout(file, size), system, name
        signal, layout = wfdb_layout(file.read().decode("latin-1"))
    return layout, system, f"{name.rpartition('/')[0]}/{signal}"


@dataclass
class Range(InputPartition):
    """The periods whose first byte is in [begin, end) of a file; the first range has its error."""

    path: str
    size: int
    begin: int
    end: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, headers: bool):
        self.path, self.headers = options["path"], headers
        self.range, self.period = int(options.get("rangebytes", RANGE)), float(options.get("period", 30))
        self.channels: set[str] | None = None
        self.first, self.last = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column == "channel" and isinstance(f, EqualTo | In):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.channels = asked if self.channels is None else self.channels & asked
            elif column == "period_idx" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low, high = isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual), isinstance(f, EqualTo | LessThan | LessThanOrEqual)
                if low:
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if high:
                    self.last = min(self.last, f.value + (not isinstance(f, LessThan)))
            yield f  # rows of an error stay until Spark has looked at them too

    def partitions(self) -> list[InputPartition]:
        system, name = opened(self.path)
        info = system.get_file_info(name)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(name, recursive=True))
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        sizes = {f.path: f.size for f in found if f.is_file and "/_" not in f.path.removeprefix(name)}
        out: list[InputPartition] = []
        for path, size in sorted(sizes.items()):
            if not path.lower().endswith((".edf", ".hea")):
                continue
            span = sizes.get(SUFFIX.sub(".dat", path), size) if path.lower().endswith(".hea") else size
            steps = [0] if self.headers else range(0, max(span, 1), self.range)
            out += [Range(prefix + path, size, a, a + self.range if a + self.range < span else 1 << 62) for a in steps]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        study = SUFFIX.sub("", part.path.rsplit("/", 1)[-1])
        schema, at_fault = HEADER_TYPES if self.headers else PERIOD_TYPES, part.begin == 0
        try:
            layout, system, name = layout_of(part.path, part.size)
            at_fault = True
            if self.headers:
                rows = [
                    (part.path, study, c.label, c.per / layout.seconds, c.per * layout.blocks, c.unit, c.prefilter, c.transducer, c.phys_min, c.phys_max, c.dig_min, c.dig_max, layout.patient, layout.recording, layout.started, None)
                    for c in layout.channels if c.label != ANNOTATIONS
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)
            else:
                yield from self.periods(part, study, layout, system, name)
        except Exception as e:  # any defect of the file
            if at_fault:  # what is wrong with a header, the first range tells
                values = [part.path, study, *[None] * (len(schema) - 3), f"{type(e).__name__}: {e}"[:500]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

    def periods(self, part: Range, study: str, layout: Layout, system: fs.FileSystem, name: str) -> Iterator[pa.RecordBatch]:
        wanted = [i for i, c in enumerate(layout.channels) if c.label != ANNOTATIONS and (self.channels is None or c.label in self.channels)]
        total = layout.blocks * layout.seconds
        block_at = lambda k: min(int(k * self.period / layout.seconds + 1e-9), layout.blocks)  # noqa: E731  that a period begins in
        n = int(-(-round(total, 6) // self.period))
        begins = np.array([layout.byte_of(block_at(k)) for k in range(n)], np.int64)
        first, last = max(int(np.searchsorted(begins, part.begin)), self.first), min(int(np.searchsorted(begins, part.end)), self.last)
        if first >= last or not wanted:
            return
        with system.open_input_file(name) as file:
            for k in range(first, last):
                begin, end = block_at(k), min(layout.blocks, -int(-((k + 1) * self.period / layout.seconds - 1e-9) // 1))
                stored = layout.stored(file, begin, end)
                samples = []
                for i in wanted:
                    c = layout.channels[i]
                    a = round(k * self.period * c.per / layout.seconds) - begin * c.per
                    b = round((k + 1) * self.period * c.per / layout.seconds) - begin * c.per
                    samples.append(c.physical(layout.of_channel(stored, i)[a:b]))
                m = len(wanted)
                offsets = pa.array(np.cumsum([0, *map(len, samples)]), pa.int32())
                rate = [layout.channels[i].per / layout.seconds for i in wanted]
                columns = [[part.path] * m, [study] * m, [layout.channels[i].label for i in wanted], rate, [k] * m]
                arrays = [pa.array(x, t) for x, t in zip(columns, PERIOD_TYPES.types)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(samples))), pa.nulls(m, pa.string())], schema=PERIOD_TYPES)


#: Types of the columns, without Spark's parser, as workers have none.
_KINDS = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "array<float>": pa.list_(pa.float32())}
PERIOD_TYPES, HEADER_TYPES = (pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(",")]) for ddl in (PERIODS, HEADERS))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are, and where they belong."""

    moves: list[tuple[str, str]]


class RecordWriter(DataSourceArrowWriter):
    """Writes one EDF file a study. Rows come sorted by study, period and channel, with header attributes on each of them; a period is
    one block. A task writes below _attempts; files take their places when all tasks are done, and go if the job fails."""

    def __init__(self, path: str, period: float):
        self.path, self.period, self.job = path, period, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        attempt, moves, study, file, expected = f"{root}/_attempts-{self.job}/{uuid.uuid4().hex}", [], None, None, []
        system.create_dir(attempt, recursive=True)
        try:
            for row in (r for batch in batches for r in batch.to_pylist()):
                if row["study_id"] != study:
                    if expected:
                        raise ValueError(f"{study} lacks channel {expected[0]} in a period")
                    if file:
                        file.close()
                    study = row["study_id"]
                    if moves and f"{root}/{study}.edf" in {m[1] for m in moves}:
                        raise ValueError(f"rows of {study} come apart; sort them by study")
                    moves.append((f"{attempt}/{study}.edf", f"{root}/{study}.edf"))
                    file = system.open_output_stream(moves[-1][0])
                    channels, at = {c["channel"]: self.channel(c) for c in row["channels"]}, 0
                    file.write(edf_head(list(channels.values()), row["n_periods"], self.period, row["patient"] or "", row["recording"] or "", row["started"] or ""))
                if not expected:
                    expected, at = list(channels), at + 1
                c = channels[row["channel"]]
                if row["channel"] != expected.pop(0) or row["period_idx"] != at - 1 or len(row["samples"]) != c.per:
                    raise ValueError(f"{study}: period {row['period_idx']} of {row['channel']} is out of turn or has {len(row['samples'])} samples, not {c.per}")
                file.write(c.stored(np.array(row["samples"])).tobytes())
            if expected:
                raise ValueError(f"{study} lacks channel {expected[0]} in a period")
        except BaseException:
            if file:
                file.close()
            system.delete_dir(attempt)
            raise
        if file:
            file.close()
        return Written(moves)

    @staticmethod
    def channel(c: dict) -> Channel:
        low, high = eight(c["phys_min"], ROUND_FLOOR), eight(c["phys_max"], ROUND_CEILING)
        return Channel(c["channel"], c["per"], c["unit"] or "", c["prefilter"] or "", c["transducer"] or "", low, high if high > low else low + 1, c["dig_min"], c["dig_max"])

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for a, b in (m for w in messages if w for m in w.moves):
            system.move(a, b)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of the job's attempts stays."""
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/_attempts-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_attempts-{self.job}")


def eight(x: float, rounding: str) -> float:
    """The nearest number below or above that EDF's eight characters can hold."""
    for digits in range(6, -1, -1):
        found = Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), rounding)
        if len(shown(float(found))) <= 8:
            return float(found)
    raise ValueError(f"{x} has too many digits for EDF")


def shown(x: float) -> str:
    return f"{x:.6f}".rstrip("0").rstrip(".")


def edf_head(channels: list[Channel], blocks: int, seconds: float, patient: str, recording: str, started: str) -> bytes:
    def pad(value, width: int) -> bytes:
        text = shown(value) if isinstance(value, float) else str(value)
        if len(text) > width:
            raise ValueError(f"{text!r} has more than the {width} characters that EDF gives it")
        return text.encode("latin-1").ljust(width)

    day, clock = (started.split() + ["01.01.85", "00.00.00"][len(started.split()) :])[:2]
    out = pad(0, 8) + pad(patient, 80) + pad(recording, 80) + pad(day, 8) + pad(clock, 8) + pad(256 * (len(channels) + 1), 8) + pad("", 44) + pad(blocks, 8) + pad(seconds, 8) + pad(len(channels), 4)
    for field, width in (("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8), ("dig_max", 8), ("prefilter", 80), ("per", 8), (None, 32)):
        out += b"".join(pad(getattr(c, field) if field else "", width) for c in channels)
    return out


class Records(DataSource):
    """Periods of signals. Options: path; period, in seconds; rangebytes."""

    headers = False

    @classmethod
    def name(cls) -> str:
        return "signal_records"

    def schema(self) -> str:
        return PERIODS

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options, self.headers)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.options["path"], float(self.options.get("period", 30)))


class RecordHeaders(Records):
    """A row for each channel of a header; signals aren't read."""

    headers = True

    @classmethod
    def name(cls) -> str:
        return "signal_headers"

    def schema(self) -> str:
        return HEADERS


def registered(spark: SparkSession) -> SparkSession:
    """spark with both sources, and filters pushed into sources written in Python."""
    spark.dataSource.register(Records)
    spark.dataSource.register(RecordHeaders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_periods(spark: SparkSession, path: str, period: float = 30, range_bytes: int = RANGE) -> DataFrame:
    """path, study_id, channel, sample_rate, period_idx, samples, error: a row for each period of each channel of all EDF and WFDB records
    below path."""
    return registered(spark).read.format("signal_records").option("period", period).option("rangebytes", range_bytes).load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).read.format("signal_headers").load(path)


def write_edf(periods: DataFrame, path: str, attributes: DataFrame, period: float = 30) -> None:
    """One EDF file a study. periods: study_id, channel, period_idx (from 0 without gaps), samples. attributes: what read_headers gives,
    of each study and channel, where null or absent columns take defaults: the samples' own range for phys_min and phys_max. A study is
    written by one task, period by period; existing files of the same studies are replaced."""
    spark = registered(periods.sparkSession)
    found = periods.groupBy("study_id", "channel").agg(
        (F.max("period_idx") + 1).alias("n_periods"), F.max(F.size("samples")).alias("per"), F.min(F.array_min("samples")).cast("double").alias("least"), F.max(F.array_max("samples")).cast("double").alias("most"),
    )
    absent = {"unit": "string", "prefilter": "string", "transducer": "string", "phys_min": "double", "phys_max": "double", "dig_min": "long", "dig_max": "long", "patient": "string", "recording": "string", "started": "string"}
    given = attributes.select("study_id", "channel", *(F.col(c).cast(t) if c in attributes.columns else F.lit(None).cast(t).alias(c) for c, t in absent.items()))
    both = found.join(given, ["study_id", "channel"], "left")
    low, high = F.coalesce("phys_min", "least"), F.coalesce("phys_max", "most")
    channel = F.struct("channel", "per", "unit", "prefilter", "transducer", low.alias("phys_min"), high.alias("phys_max"), F.coalesce("dig_min", F.lit(-32768)).alias("dig_min"), F.coalesce("dig_max", F.lit(32767)).alias("dig_max"))
    studies = both.groupBy("study_id").agg(F.array_sort(F.collect_list(channel)).alias("channels"), F.max("n_periods").alias("n_periods"), *(F.max(c).alias(c) for c in ("patient", "recording", "started")))
    rows = periods.select(F.col("study_id").cast("string").alias("study_id"), "channel", F.col("period_idx").cast("long").alias("period_idx"), F.col("samples").cast("array<float>").alias("samples"))
    rows = rows.join(studies.withColumn("study_id", F.col("study_id").cast("string")), "study_id")
    rows.repartition("study_id").sortWithinPartitions("study_id", "period_idx", "channel").write.format("signal_records").option("period", period).mode("append").save(path)
