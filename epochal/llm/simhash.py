"""SimHash near-duplicates by anchor points of a covering code.

Two fingerprints within 4 bits of each other differ by at most 1 bit in one of three blocks (21, 21 and 22 bits), and by at most 2
in one of two blocks of 32. Each block has a covering code of radius 1: a perfect Hamming code over its first bits, and every value of
the rest. A fingerprint's home is the codeword nearest to it; a fingerprint goes to every codeword within covering radius plus
threshold, 1 + 1 or 1 + 2 bits. So for two linked fingerprints some block's home of the one is an anchor of the other, and comparing
homes with all others at each anchor finds every link. Equal fingerprints are one node. Each task reduces the links it finds to stars
before it emits them, and components come from alternating star contractions, whose edges never leave the cluster.

Three blocks make 45 copies of a fingerprint and have 2**17 or 2**18 anchors each, two blocks some 340 and 2**27. Comparisons at an anchor
grow with the square of its rows, so beyond MANY fingerprints, where they would outweigh the copies, the two longer blocks are
used; the links are the same. An anchor with more fingerprints than CELL is set aside and dealt as cells (part of the homes, part of
all), so no task holds more than CELL rows of an anchor or compares them with more than as many. The rows of one fingerprint, root or
star centre are dealt over SALTS parts wherever they are joined.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a null doc_id never is a component's id
unless all its documents have none (then null); repeated rows are rows of their own; an empty table gives an empty result. Of rows that could each be
the one kept, it is the one with the least id, then hash of the text, then hash of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from epochal.llm.common import discard, materialize, row_hash, spread, table, unused

WORDS, SEED, THRESHOLD = 4, 42, 4
#: First bits and lengths of the blocks, how many of a block's first bits carry the Hamming code, and how far a fingerprint goes.
THREE, TWO = (((0, 21), (21, 21), (42, 22)), 15, 2), (((0, 32), (32, 32)), 31, 3)
MANY, CELL, SALTS = 1 << 28, 4096, 32
#: Fingerprints compared at once, in pairs.
PAIRS = 1 << 21


def fingerprint(text: str | None) -> int:
    """Unsigned. Bits set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - WORDS + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    last = ends[min(WORDS, len(words)) - 1 :].tolist()
    first = starts[:n].tolist()
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and fp (signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.columns[-1]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*keep, "fp"])

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("fp", LongType())]))


def syndromes(words: np.ndarray, coded: int = THREE[1]) -> np.ndarray:
    """The XOR of the places, from 1, of the set bits among the coded ones; zero for codewords."""
    out = np.zeros_like(words)
    for bit in range(coded):
        out ^= np.where(words >> np.uint64(bit) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return out


def nearest_codeword(words: np.ndarray, coded: int = THREE[1]) -> np.ndarray:
    """Of a perfect Hamming code: the syndrome is the place of the bit to flip."""
    syndrome = syndromes(words, coded)
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return words ^ flip


@lru_cache(maxsize=None)
def flips(length: int, coded: int, most: int) -> list[np.ndarray]:
    """By syndrome: the sets of at most so many bits that turn a block with that syndrome into a codeword, the nearest first."""
    out = [[] for _ in range(coded + 1)]
    for n in range(most + 1):
        for bits in combinations(range(length), n):
            syndrome = 0
            for bit in bits:
                syndrome ^= bit + 1 if bit < coded else 0
            out[syndrome].append(sum(1 << bit for bit in bits))
    return [np.array(x, dtype=np.uint64) for x in out]


def anchors(fps: np.ndarray, scheme: tuple = THREE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, fingerprint, and whether the anchor is its home: for every codeword near enough."""
    blocks, coded, most = scheme
    keys, rows, homes = [], [], []
    for number, (low, length) in enumerate(blocks):
        block = fps >> np.uint64(low) & np.uint64((1 << length) - 1)
        syndrome = syndromes(block, coded)
        for k, masks in enumerate(flips(length, coded, most)):
            at = np.flatnonzero(syndrome == k)
            key = block[at][:, None] ^ masks[None, :] | np.uint64(number << 34)
            home = np.zeros(key.shape, bool)
            home[:, 0] = True  # of the least flips there is one only
            keys.append(key.ravel().view(np.int64))
            rows.append(np.repeat(at, len(masks)))
            homes.append(home.ravel())
    return np.concatenate(keys), fps.view(np.int64)[np.concatenate(rows)], np.concatenate(homes)


def anchored(nodes: DataFrame, scheme: tuple = THREE) -> DataFrame:
    """anchor, fp, home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in anchors(fps[at : at + 4096], scheme)], ["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints as stars: each one but the least of its component, and the least."""
    names, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = flat[: len(a)], flat[len(a) :], np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = label != np.arange(len(names))
    return names[leaf], names[label[leaf]]


def links_within(cells: np.ndarray, fps: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of homes with all others of their cell, as stars. Cells are runs."""
    order = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    ends = np.append(order[1:], len(cells))
    run = np.repeat(np.arange(len(order)), ends - order)
    home = np.flatnonzero(homes)
    width = (ends - order)[run[home]]
    out_a, out_b, at = [], [], 0
    total = np.cumsum(width)
    while at < len(home):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS)))
        w, h = width[at:until], home[at:until]
        left = np.repeat(h, w)
        right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(order[run[h]], w)
        a, b = fps[left], fps[right]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD) & (a != b)
        if near.any():
            s = stars(a[near], b[near])
            out_a.append(s[0])
            out_b.append(s[1])
        at = until
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return stars(np.concatenate(out_a), np.concatenate(out_b))


FOUND = "anchor bigint, a bigint, b bigint, home boolean"


def compared(rows: DataFrame, most: int | None) -> DataFrame:
    """rows: cell, fp, home, sorted by cell within partitions. Links as (null, a, b, null); of cells with more than `most` rows,
    the rows themselves as (cell, fp, null, home)."""

    def links(parts: list[np.ndarray]) -> pa.RecordBatch:
        a, b = links_within(*parts)
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b), pa.nulls(len(a), pa.bool_())], ["anchor", "a", "b", "home"])

    def aside(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts[0]), pa.array(parts[1]), pa.nulls(len(parts[0]), pa.int64()), pa.array(parts[2])], ["anchor", "a", "b", "home"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(new[0]):
                continue
            if large is not None:  # the rest of a cell that is set aside
                n = int(np.searchsorted(new[0], large, side="right"))
                if n:
                    yield aside([x[:n] for x in new])
                new = [x[n:] for x in new]
                if not len(new[0]):
                    continue
                large = None
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            begin = np.flatnonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))
            sizes = np.diff(np.append(begin, len(held[0])))
            if most is not None and (sizes > most).any():
                over = np.repeat(sizes > most, sizes)
                yield aside([x[over] for x in held])
                if over[-1]:
                    large = held[0][-1]
                    begin = np.append(begin, len(over))
                last = begin[-1]
                done = ~over & (np.arange(len(over)) < last)
                yield links([x[done] for x in held])
            else:
                last = begin[-1]
                yield links([x[:last] for x in held])
            held = [x[last:] for x in held] if last < len(held[0]) else None
        if held is not None:
            yield links(held)

    return rows.mapInArrow(run, FOUND)


def found_links(nodes: DataFrame, cell: int = CELL, many: int = MANY) -> DataFrame:
    """a, b: links between fingerprints, enough of them to connect what is connected."""
    spark = nodes.sparkSession
    n, scheme = int(spark.conf.get("spark.sql.shuffle.partitions")), THREE if nodes.count() <= many else TWO
    # nodes are few bytes, which would be put into few tasks, but each makes many rows
    at_anchor = anchored(nodes.select("fp").repartition(n, F.xxhash64("fp")), scheme).repartition(n, "anchor").sortWithinPartitions("anchor")
    found = materialize(compared(at_anchor, cell), "simhash")
    links = found.filter("anchor is null").select("a", "b")
    rest = found.filter("anchor is not null").select("anchor", F.col("a").alias("fp"), "home")
    sizes = rest.groupBy("anchor").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    rest = rest.join(sizes, "anchor").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    as_other = rest.select("anchor", every.alias("i"), F.col("part").alias("j"), "fp", F.lit(False).alias("home"))
    as_home = rest.filter("home").select("anchor", F.col("part").alias("i"), every.alias("j"), "fp", F.lit(True).alias("home"))
    cells = as_other.unionByName(as_home).select(F.xxhash64("anchor", "i", "j").alias("cell"), "fp", "home")
    cells = cells.repartition(n, "cell").sortWithinPartitions("cell")
    return links.unionByName(compared(cells, None).select("a", "b")).distinct()


def with_least(rows: DataFrame, key: str, value: str, deal: str, out: str) -> DataFrame:
    """rows and out, the least value of all with the same key. The rows of a key are dealt over SALTS parts by a hash of the column
    deal, so none is joined in one task, and only keys with many rows have many parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.min(value).alias("least"))
    least = parts.groupBy(key).agg(F.min("least").alias(out))
    return salted.join(parts.select(key, "salt").join(least, key), [key, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node with a link, the least node that it reaches. Alternating large-star and small-star steps; a
    step's links are written to the shared folder, so lineage stays short."""
    links, before = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "b", "m").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        # a node's own link to its least stands for (a, m)
        small = with_least(large, "a", "b", "b", "m").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        last, links = links, materialize(small, "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(last)
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def joined(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns (doc_id among them), fp, root (the component's least fingerprint), component_id: one row per input row."""
    rows = materialize(fingerprints(docs, *keep), "fingerprints").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    nodes = materialize(parts.groupBy("fp").agg(F.min("least").alias("least")), "nodes")
    roots = components(found_links(nodes))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = with_least(named, "root", "least", "fp", "component_id").select("fp", "root", "component_id")
    return rows.join(parts.select("fp", "salt").join(named, "fp"), ["fp", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id of the component): one row per input row."""
    return joined(spread(docs), "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, of each component only one row: that with the smallest id (rows without an id only where there is no other), as said
    above. The columns stay. Rows are numbered and written once, and the numbers of those that stay are joined."""
    (number,) = unused(docs, "number")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    of_text = spread(numbered.select("doc_id", F.xxhash64("text").alias("digest"), row_hash(docs).alias("all"), F.col(number).alias("number"), "text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "all", "number"))
    first = joined(of_text, "doc_id", "digest", "all", "number").groupBy("root").agg(least["number"].alias(number))
    return numbered.join(first.select(number).hint("merge"), number, "left_semi").select(docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
