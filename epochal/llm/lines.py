"""Line dedup by sharded cuckoo filters over exact reference counts, with insertions and document deletions.

A line's key is the line without ASCII white space at both ends, A-Z in lower case; keys of fewer than MIN_POINTS code points aren't
indexed. Keys are held as BLAKE2 digests of 128 bits. An index is a folder of three tables, each with a directory per version:

- references: a row for every key of every document inserted (n = 1) or deleted (n = -1);
- counts: for every key that the version touched, in how many documents it is now and the largest doc_id of these;
- filters: per shard (leading bits of the key) a cuckoo filter with one 16-bit fingerprint for each live key of the shard.

Of the keys of an insertion, those whose fingerprint isn't in their shard's filter are new for certain; only the others are looked up
in the older counts. Keys that come to life or die move their fingerprint into the filter or out of it, so filters hold exactly the
live keys of the exact table, and are rebuilt from it when the shards have to become more. A deletion recounts the keys of
the deleted documents from their references, so it undoes an insertion exactly, in any order. A version counts once its row in
the table commits is written; what a broken attempt has left is deleted by the next one.

Defined cases: a null or empty text is one empty line; every row is a document of its own (repeated rows count each); a key found in
MIN_DOCS rows or more loses its lines in all rows but those with its largest doc_id, and null is smaller than any doc_id; deleting a
document that isn't there changes nothing; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epochal.llm.common import materialize, new_path, salted_join, spread, table, unused

MIN_POINTS, MIN_DOCS = 20, 3
#: A filter has 2**16 buckets of 4 fingerprints; its shard takes keys up to this load.
BUCKETS, WIDTH, LOAD, ROUNDS = 1 << 16, 4, 0.8, 200
#: Parts in which a table is inserted, each asking the filters of those before.
LOADS = 2


def keys_of(text: bytes | None) -> Iterator[tuple[int, tuple[int, int]]]:
    """Line number and key of every line that is indexed."""
    for at, line in enumerate((text or b"").split(b"\n")):
        key = line.strip().lower()  # of bytes: ASCII only
        if len(key) >= MIN_POINTS and (len(key) >= 4 * MIN_POINTS or len(key.decode()) >= MIN_POINTS):
            yield at, struct.unpack(">qq", hashlib.blake2b(key, digest_size=16).digest())


def keyed(docs: DataFrame) -> DataFrame:
    """hi, lo, doc_id, digest (of the text): a row for each distinct key of a document."""
    rows = spread(docs).select("doc_id", F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch, at, keys = whole.slice(begin, 1024), [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    found = {k for _, k in keys_of(text)}
                    keys += found
                    at += [i] * len(found)
                pairs = np.array(keys, np.int64).reshape(-1, 2)
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column("doc_id").take(at), batch.column("digest").take(at)], ["hi", "lo", "doc_id", "digest"])

    return rows.mapInArrow(run, StructType().add("hi", "long").add("lo", "long").add(rows.schema["doc_id"]).add("digest", "long"))


class Cuckoo:
    """A cuckoo filter that adds, removes and looks up arrays of keys at once. What finds no place within ROUNDS goes to a stash."""

    def __init__(self, slots: bytes | None = None, stash: list[int] | None = None):
        self.slots = np.zeros((BUCKETS, WIDTH), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(BUCKETS, WIDTH).copy()
        self.stash = list(stash or [])

    @staticmethod
    def places(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket and fingerprint (never 0) of keys."""
        mark = (lo & 0xFFFF).astype(np.uint16)
        return (hi & 0xFFFF).astype(np.int64), np.where(mark == 0, np.uint16(1), mark)

    @staticmethod
    def other(bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x9E3779B1 >> 13) & 0xFFFF | 1)

    def stashed(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return np.minimum(bucket, self.other(bucket, mark)) << 16 | mark

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        bucket, mark = self.places(hi, lo)
        found = (self.slots[bucket] == mark[:, None]).any(1) | (self.slots[self.other(bucket, mark)] == mark[:, None]).any(1)
        return found | np.isin(self.stashed(bucket, mark), self.stash)

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        bucket, mark = self.places(hi, lo)
        for turn in range(ROUNDS):
            if not len(bucket):
                return
            order = np.argsort(bucket, kind="stable")
            bucket, mark = bucket[order], mark[order]
            n = np.arange(len(bucket))
            rank = n - np.maximum.accumulate(np.where(np.r_[True, bucket[1:] != bucket[:-1]], n, 0))
            free = self.slots[bucket] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[n, np.minimum(rank, WIDTH - 1)]
            self.slots[bucket[fits], slot[fits]] = mark[fits]
            bucket, mark, rank = bucket[~fits], mark[~fits], rank[~fits]
            if turn:  # one key a bucket takes the place of another, which moves on
                first = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
                where = (bucket[first], (mark[first] + turn) % WIDTH)
                mark[first], self.slots[where] = self.slots[where], mark[first].copy()
            bucket = self.other(bucket, mark)
        self.stash += self.stashed(bucket, mark).tolist()

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """One fingerprint of each key, all of which have one."""
        bucket, mark = self.places(hi, lo)
        while len(bucket):
            code = self.stashed(bucket, mark)
            in_one, in_two = self.slots[bucket] == mark[:, None], self.slots[self.other(bucket, mark)] == mark[:, None]
            held = np.where(in_one.any(1), bucket, self.other(bucket, mark))
            slot = np.where(in_one.any(1), in_one.argmax(1), in_two.argmax(1))
            there = in_one.any(1) | in_two.any(1)
            for x in code[~there].tolist():
                self.stash.remove(x)
            _, first = np.unique((held * WIDTH + slot)[there], return_index=True)
            self.slots[held[there][first], slot[there][first]] = 0
            left = np.delete(np.flatnonzero(there), first)
            bucket, mark = bucket[left], mark[left]


def shard(bits: int) -> Column:
    return (F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0).cast("long")).alias("shard")


def asked(keys: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """keys (hi, lo and more) with maybe: whether the shard's filter holds the key."""
    names = [*keys.columns, "maybe"]

    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        cuckoo = Cuckoo(*(held.select(["slots", "stash"]).to_pylist()[0].values() if held.num_rows else ()))
        maybe = cuckoo.holds(rows["hi"].to_numpy(), rows["lo"].to_numpy())
        return rows.append_column("maybe", pa.array(maybe)).select(names)

    dealt = keys.select(shard(bits), *keys.columns)
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, StructType([*keys.schema.fields]).add("maybe", "boolean"))


def changed(filters: DataFrame | None, moves: DataFrame, bits: int) -> DataFrame:
    """shard, slots, stash: the filters after moves (hi, lo, born), from empty ones where there are none."""
    schema = "shard long, slots binary, stash array<long>"
    filters = moves.sparkSession.createDataFrame([], schema) if filters is None else filters

    def run(key, rows: pa.Table, held: pa.Table) -> pa.Table:
        cuckoo = Cuckoo(*(held.select(["slots", "stash"]).to_pylist()[0].values() if held.num_rows else ()))
        hi, lo, born = (rows[c].to_numpy() for c in ("hi", "lo", "born"))
        cuckoo.remove(hi[~born], lo[~born])
        cuckoo.add(hi[born], lo[born])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "slots": pa.array([cuckoo.slots.tobytes()], pa.binary()), "stash": pa.array([cuckoo.stash], pa.list_(pa.int64()))})

    dealt = moves.select(shard(bits), "hi", "lo", "born")
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, schema)


class LineIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.version, self.bits, self.live = 0, 0, 0
        done = [v for v in self.versions("commits") if self.exists(f"commits/version={v}/_SUCCESS")]
        if done:
            last = spark.read.parquet(f"{folder}/commits/version={max(done)}").first()
            self.version, self.bits, self.live = max(done), last["bits"], last["live"]
        for name in ("commits", "references", "counts", "filters"):
            for v in self.versions(name):
                if v > self.version:  # of an attempt that broke
                    path, files = self.path(f"{name}/version={v}")
                    files.delete(path, True)

    def path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, files = self.path(name)
        return files.exists(path)

    def versions(self, name: str) -> list[int]:
        path, files = self.path(name)
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return [int(n.split("=")[1]) for n in names if n.startswith("version=")]

    def read(self, name: str) -> DataFrame:
        """All committed rows of a table, with their version."""
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*(f"{self.folder}/{name}/version={v}" for v in range(1, self.version + 1)))

    def filters(self) -> DataFrame:
        """shard, slots, stash: every version writes all shards."""
        return self.spark.read.parquet(f"{self.folder}/filters/version={self.version}")

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """hi, lo, docs, last: of every key in the index that is among the given ones, in how many documents it is and the largest of them."""
        rows = self.read("counts")
        if keys is not None:
            rows = rows.join(keys.select("hi", "lo"), ["hi", "lo"], "left_semi")
        now = rows.groupBy("hi", "lo").agg(F.max_by(F.struct("docs", "last"), "version").alias("now"))
        return now.select("hi", "lo", "now.docs", "now.last").filter("docs > 0")

    def commit(self, delta: DataFrame) -> None:
        """A version of counts (hi, lo, docs, last, born: true, false, or null where the key lived and lives) and the filters that follow from it."""
        version = self.version + 1
        delta.write.parquet(f"{self.folder}/counts/version={version}")
        delta = self.spark.read.schema(delta.schema).parquet(f"{self.folder}/counts/version={version}")
        change = delta.agg(F.sum(F.when(F.col("born"), 1).when(~F.col("born"), -1))).first()[0] or 0
        live, before = self.live + change, self.version
        bits = max(self.bits, math.ceil(math.log2(max(1, live / (LOAD * BUCKETS * WIDTH)))))
        rebuilt = bits > self.bits
        old = None if rebuilt or not before else self.filters()
        self.version, self.bits, self.live = version, bits, live
        moves = self.counts().withColumn("born", F.lit(True)) if rebuilt else delta.filter("born is not null")
        changed(old, moves, bits).write.parquet(f"{self.folder}/filters/version={version}")
        self.spark.createDataFrame([(bits, live)], "bits int, live long").coalesce(1).write.parquet(f"{self.folder}/commits/version={version}")

    def insert(self, docs: DataFrame, loads: int = LOADS) -> None:
        """Adds documents in as many loads, each a version."""
        first = self.version + 1
        load = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(loads)) + first
        rows = keyed(docs).select("hi", "lo", "doc_id", "digest", F.lit(1).alias("n"), load.cast("int").alias("version"))
        rows.write.mode("append").partitionBy("version").parquet(f"{self.folder}/references")
        of_all = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/references")
        for version in range(first, first + loads):
            if not self.exists(f"references/version={version}"):  # a load without rows
                rows.filter("false").drop("version").write.parquet(f"{self.folder}/references/version={version}")
            batch = of_all.filter(F.col("version") == version).groupBy("hi", "lo").agg(F.count("*").alias("more"), F.max("doc_id").alias("top"))
            if not self.version:
                self.commit(batch.select("hi", "lo", F.col("more").alias("docs"), F.col("top").alias("last"), F.lit(True).alias("born")))
                continue
            batch = materialize(asked(batch, self.filters(), self.bits), "asked")
            seen = batch.filter("maybe")
            seen = seen.join(self.counts(seen), ["hi", "lo"], "left")
            new = batch.filter("not maybe").select("hi", "lo", F.col("more").alias("docs"), F.col("top").alias("last"), F.lit(True).alias("born"))
            # max, as greatest, passes over nulls
            last = F.when(F.col("last").isNull() | (F.col("top") > F.col("last")), F.col("top")).otherwise(F.col("last"))
            known = seen.select("hi", "lo", (F.col("more") + F.coalesce("docs", F.lit(0))).alias("docs"), last.alias("last"), F.when(F.col("docs").isNull(), True).alias("born"))
            self.commit(new.unionByName(known))

    def delete(self, docs: DataFrame) -> None:
        """Takes documents out again. Their keys are recounted from the references."""
        gone = materialize(keyed(docs).groupBy("hi", "lo", "doc_id", "digest").agg(F.count("*").alias("asked")), "gone")
        if not self.version:
            return
        keys, same = gone.select("hi", "lo").distinct(), ["hi", "lo", "doc_id", "digest"]
        held = self.read("references").select(*same, "n").join(keys, ["hi", "lo"], "left_semi").groupBy(*same).agg(F.sum("n").alias("n")).filter("n > 0")
        held, gone = held.alias("h"), gone.alias("g")
        match = [F.col(f"h.{c}").eqNullSafe(F.col(f"g.{c}")) for c in same]
        both = materialize(held.join(gone, match[0] & match[1] & match[2] & match[3], "left").select("h.*", F.least("n", F.coalesce("asked", F.lit(0))).cast("int").alias("less")), "held")
        both.filter("less > 0").select(*same, (-F.col("less")).alias("n")).write.parquet(f"{self.folder}/references/version={self.version + 1}")
        left = F.col("n") - F.col("less")
        now = both.groupBy("hi", "lo").agg(F.sum(left).alias("docs"), F.max(F.when(left > 0, F.col("doc_id"))).alias("last"), F.sum("less").alias("less"))
        self.commit(now.filter("less > 0").select("hi", "lo", "docs", "last", F.when(F.col("docs") == 0, False).alias("born")))

    def cleaned(self, docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """docs without the lines that repeat, and the columns n_lines and n_dropped. rows: what keyed gives of docs, if at hand."""
        often = self.counts().filter(F.col("docs") >= MIN_DOCS).select("hi", "lo", "last")
        rows = (keyed(docs) if rows is None else rows).select("hi", "lo", "doc_id", "digest")
        hits = salted_join(rows, often, ["hi", "lo"], "digest").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        drops = hits.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))
        i, h, d, n_lines, n_dropped = unused(docs, "i", "h", "drops", "n_lines", "n_dropped")
        drops = drops.select(F.col("doc_id").alias(i), F.col("digest").alias(h), F.col("drops").alias(d))
        both = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left").select(*docs.columns, d)
        at, names = docs.columns.index("text"), [*docs.columns, n_lines, n_dropped]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, 1024):
                    batch, texts, counts = whole.slice(begin, 1024), [], []
                    for text, keys in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(d).to_pylist()):
                        n, dropped = (text or b"").count(b"\n") + 1, 0
                        if keys:
                            keys = {(k["hi"], k["lo"]) for k in keys}
                            away = {j for j, k in keys_of(text) if k in keys}
                            text, dropped = b"\n".join(line for j, line in enumerate(text.split(b"\n")) if j not in away), len(away)
                        texts.append(text)
                        counts.append((n, dropped))
                    columns = [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in zip(*counts))]
                    columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names)

        return both.mapInArrow(run, StructType(list(docs.schema.fields)).add(n_lines, "long").add(n_dropped, "long"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without repeated lines, and n_lines and n_dropped: by an index of docs alone."""
    index = LineIndex(docs.sparkSession, new_path(docs.sparkSession, "line-index"))
    index.insert(docs)
    return index.cleaned(docs, index.read("references"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_sql() -> str:
    return """WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS nth FROM split),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, (last IS NOT NULL AND doc_id <> last) AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
