"""Removal of repeated passages by suffix arrays.

A byte goes if a WINDOW of bytes that covers it also starts earlier: in a document with a smaller id, or earlier in its own. A
suffix array over all texts would show equal windows as neighbours; here the suffixes are dealt out so that equal windows always
meet, and each bucket's suffixes are sorted by themselves (see suffixes.py, a linear grouping construction).

1. Windows are dealt by anchor (see anchors.py), one record for a run of windows with one anchor. Records whose stretch of text is
   the same are one string; all but its first occurrence go. Only anchors that stand in different stretches need sorting.
2. Those stretches are fetched, cut in two (windows that begin well before the anchor and the others), and dealt by the anchor and
   HALF bytes beside it, which all of a half's windows contain. Each bucket's distinct stretches are suffix-sorted, and equal
   windows are found as neighbours in the suffix array and compared byte by byte.
3. A bucket with more than MOST stretches is divided, so no task holds an unbounded one: its windows are dealt anew by longer keys, the
   95 bytes that up to six neighbouring windows share, and suffix-sorted in these smaller buckets; the few buckets that are still
   too large are divided by all 100 bytes, which leaves one string in a bucket and nothing to sort.
4. Each document's windows are united and cut out.

Records are reduced within each piece of a task before they are shuffled, so passages on a third of all documents meet as a few
records per task. What the steps leave is written to the shared folder. Stretches count as the same string in steps 1 and 3 if two
64-bit hashes (of the anchor or key, and of the whole stretch with its length) both agree.

A text is known by its doc_id and 80 bits of two hashes of the text, so rows with one doc_id or none are told apart.

Defined cases: a null text is empty; a null doc_id comes after all others; ids that are no integers come in their own order; rows
with one doc_id and different texts are kept apart, and equal rows, which are in the same place, don't remove each other; an empty
table gives an empty result. A text is worked on whole, with some 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from epochal.llm.anchors import K, WINDOW, Piece, mixed
from epochal.llm.common import materialize, spread, table
from epochal.llm.suffixes import ragged, suffix_arrays

HALF, MOST = 34, 64
#: Windows of a bucket that share a longer key, each time buckets are divided.
DIVISIONS = (6, 1)
#: Bytes of text, and of stretches to sort, that a task works on at once.
TEXT_PIECE, SORT_PIECE = 1 << 21, 1 << 20
LAST_ID = (1 << 63) - 1
#: A place in the corpus is doc, own (a hash of the text) and pack: start, the distance from it of the anchor or key, the number of
#: windows from there (0: a span, whose end is in hc), and 16 bits of another hash of the text.
RECORD = "hk bigint, hc bigint, doc bigint, own bigint, pack bigint"


def packed(start: np.ndarray, windows: np.ndarray | int, mark: np.ndarray, anchor: np.ndarray | int = 0) -> np.ndarray:
    return start.astype(np.int64) << 30 | np.asarray(anchor, np.int64) << 23 | np.asarray(windows, np.int64) << 16 | mark


def unpacked(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, windows, mark, anchor."""
    return pack >> 30, pack >> 16 & 0x7F, pack & 0xFFFF, pack >> 23 & 0x7F


def windows_of(pack: str = "pack"):
    return F.shiftright(pack, 16).bitwiseAND(0x7F)


def text_pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > TEXT_PIECE:
            yield at, i
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


class Texts:
    """Some documents' texts as one piece."""

    def __init__(self, texts: list[bytes]):
        self.bounds = np.cumsum([0, *map(len, texts)])
        self.piece = Piece(np.frombuffer(b"".join(texts), np.uint8), self.bounds)
        self.marks = (self.piece.hashes(self.bounds[:-1], self.bounds[1:]) & np.uint64(0xFFFF)).astype(np.int64)


def later(new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of rows sorted by key and place, where new marks those that begin a key: which come after the first place (doc and start)
    of their key."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc > doc[first]) | (doc == doc[first]) & (start > start[first])


def turns(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in any of the keys."""
    if not len(keys[0]):
        return np.empty(0, bool)
    differ = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        differ |= k[1:] != k[:-1]
    return np.concatenate(([True], differ))


def spans_as_records(doc: np.ndarray, own: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    return [mixed(start.astype(np.uint64) ^ own.astype(np.uint64)).view(np.int64), end, doc, own, packed(start, 0, mark)]


def united(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch as one, by owner. Sorted by owner and start."""
    if not len(owner):
        return owner, start, end
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(owner * far + end)
    new = np.concatenate(([True], owner[1:] * far + start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return owner[at], start[at], reach[np.append(at[1:], len(owner)) - 1] - owner[at] * far


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], pa.RecordBatch]]:
    """doc, own and texts of (doc, own, text, ...) rows, a piece at a time."""
    for batch in batches:
        docs, owns = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        texts = [(x.as_py() or "").encode() for x in batch.column(2)]
        for a, b in text_pieces(texts):
            yield docs[a:b], owns[a:b], texts[a:b], batch.slice(a, b - a)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and doc (integers in the order of doc_id, null last) and own (a hash of the text)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)))
    # numbers that rise along the sorted ids, over all partitions
    order = docs.select("doc_id").filter("doc_id is not null").distinct().sort("doc_id").withColumn("doc", F.monotonically_increasing_id())
    return rows.join(materialize(order, "ids"), "doc_id", "left").withColumn("doc", F.coalesce("doc", F.lit(LAST_ID)))


def records(docs: DataFrame) -> DataFrame:
    """A record for each run of windows with one anchor; runs that come after an equal one in the same piece as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, owns, texts, _ in batches_of(batches):
            t = Texts(texts)
            text, first, last, anchor, hk = t.piece.runs()
            hc = t.piece.hashes(first, last + WINDOW)
            start, doc = first - t.bounds[text], docs[text]
            order = np.lexsort((start, doc, hc, hk))
            dup = later(turns(hk[order], hc[order]), doc[order], start[order])
            gone, left = order[dup], order[~dup]
            gone = gone[np.lexsort((start[gone], text[gone]))]
            row, a, b = united(text[gone], start[gone], last[gone] - t.bounds[text[gone]] + WINDOW)
            one = [hk[left].view(np.int64), hc[left].view(np.int64), doc[left], owns[text[left]], packed(start[left], (last - first + 1)[left], t.marks[text[left]], (anchor - first)[left])]
            two = spans_as_records(docs[row], owns[row], t.marks[row], a, b)
            yield record_batch(one, two)

    return spread(docs.select("doc_id", "doc", "own", "text")).select("doc", "own", "text").mapInArrow(run, RECORD)


def record_batch(*parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["hk", "hc", "doc", "own", "pack"])


def placed_first(key: np.ndarray, second: np.ndarray, doc: np.ndarray, own: np.ndarray, pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key, second, doc, pack and own: which come after the first place of their key and second; which of the others
    repeat the row before; and which begin a key and second."""
    new = turns(key, second)
    after = later(new, doc, unpacked(pack)[0])
    again = ~new & ~after & ~turns(pack, own)
    return after, again, new


def first_occurrences(rows: DataFrame) -> DataFrame:
    """doc, own, pack, end of the records sorted by hk, hc, doc, pack and own: spans of those that come after an equal record, and the
    first ones of every hc whose hk has another. Goes along the stream and holds one batch and one record, but no group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several_held = None, False
        for batch in batches:
            hk, hc, doc, own, pack = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            span = unpacked(pack)[1] == 0
            out = [(doc[span], own[span], pack[span], hc[span])]
            new_rows = [x[~span] for x in (hk, hc, doc, own, pack)]
            if len(new_rows[0]):
                carried = len(held[0]) if held else 0
                hk, hc, doc, own, pack = (np.concatenate(x) for x in zip(held, new_rows)) if held else new_rows
                after, again, new = placed_first(hk, hc, doc, own, pack)
                group = np.cumsum(turns(hk)) - 1
                kinds = np.bincount(group, weights=new)
                kinds[0] += several_held
                several = kinds[group] > 1
                start, windows, mark, _ = unpacked(pack)
                out.append((doc[after], own[after], packed(start[after], 0, mark[after]), (start + windows - 1 + WINDOW)[after]))
                first = ~after & ~again
                give = first & several
                if several_held:
                    give[:carried] = False
                out.append((doc[give], own[give], pack[give], start[give]))
                several_held = bool(several[-1])
                if several_held:
                    tail = np.flatnonzero(new)[-1:]
                else:
                    tail = np.flatnonzero(first & (group == group[-1]))
                held = [x[tail] for x in (hk, hc, doc, own, pack)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["doc", "own", "pack", "end"])

    return rows.mapInArrow(run, "doc bigint, own bigint, pack bigint, end bigint")


STRETCH = "key bigint, hc bigint, doc bigint, own bigint, pack bigint, stretch binary"


def halves(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stretches of the wanted records, cut in two. wanted: doc, own, packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, owns, texts, part in batches_of(batches):
            t = Texts(texts)
            lists = part.column(3)
            text = np.repeat(np.arange(len(docs)), np.diff(lists.offsets.to_numpy()))
            start, windows, mark, anchor = unpacked(lists.flatten().to_numpy(zero_copy_only=False))
            its = mark == t.marks[text]
            text, start, windows, anchor = (x[its] for x in (text, start, windows, anchor))
            first = start + t.bounds[text]
            last, at = first + windows - 1, first + anchor
            left, right = first <= at - HALF, last > at - HALF
            core = np.concatenate([at[left] - HALF, at[right]])
            key = t.piece.hashes(core, core + K + HALF)
            key[left.sum() :] = ~key[left.sum() :]
            text = np.concatenate([text[left], text[right]])
            first, last = np.concatenate([first[left], np.maximum(first, at - HALF + 1)[right]]), np.concatenate([np.minimum(last, at - HALF)[left], last[right]])
            start = first - t.bounds[text]
            yield stretches(t.piece, key, docs[text], owns[text], t.marks[text], start, first, last, core)

    return docs.select("doc_id", "doc", "own", "text").join(wanted, ["doc", "own"]).select("doc", "own", "text", "packs").mapInArrow(run, STRETCH)


def stretches(piece: Piece, key: np.ndarray, doc: np.ndarray, own: np.ndarray, mark: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray, core: np.ndarray) -> pa.RecordBatch:
    """As STRETCH rows: those with windows first to last of the piece, which are at start in their texts and contain the core. Those that
    come after an equal one of their key as spans."""
    key, hc = key.view(np.int64), piece.hashes(first, last + WINDOW).view(np.int64)
    pack = packed(start, last - first + 1, mark, core - first)
    order = np.lexsort((own, pack, doc, hc, key))
    after, again, _ = placed_first(key[order], hc[order], doc[order], own[order], pack[order])
    gone, kept = order[after], order[~after & ~again]
    gone = gone[np.lexsort((start[gone], mark[gone], own[gone], doc[gone]))]
    whose = np.cumsum(turns(doc[gone], own[gone], mark[gone])) - 1 if len(gone) else gone
    row, a, b = united(whose, start[gone], (last - first)[gone] + start[gone] + WINDOW)
    row = gone[np.searchsorted(whose, row)] if len(gone) else gone
    one = [key[kept], hc[kept], doc[kept], own[kept], pack[kept]]
    two = spans_as_records(doc[row], own[row], mark[row], a, b)
    data = piece.data.tobytes()
    cut = [data[i:j] for i, j in zip(first[kept].tolist(), (last[kept] + WINDOW).tolist())]
    return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(one, two)), pa.array(cut + [b""] * len(row), pa.binary())], ["key", "hc", "doc", "own", "pack", "stretch"])


def equal_windows(bucket: np.ndarray, doc: np.ndarray, own: np.ndarray, pack: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """Spans, as records, of the windows in these stretches that come after an equal one of their bucket. Buckets are runs."""
    sizes = np.array([len(x) for x in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    symbols = data.astype(np.int64) + 2
    closing = begin + sizes
    symbols[closing] = 1
    last = np.append(bucket[1:] != bucket[:-1], True)
    symbols[closing[last]] = 0
    order = suffix_arrays(symbols, begin[np.concatenate(([True], last[:-1]))])
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    fits = np.arange(len(data)) <= (closing - WINDOW)[row]
    order = order[fits[order]]
    row = row[order]
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(bucket[row[1:]] == bucket[row[:-1]]) + 1
    across = np.arange(WINDOW)
    for at in range(0, len(near), 1 << 15):
        part = near[at : at + (1 << 15)]
        same[part] = (data[order[part][:, None] + across] == data[order[part - 1][:, None] + across]).all(axis=1)
    kind = np.cumsum(~same)
    several = np.bincount(kind, minlength=1)[kind] > 1
    order, row, kind = order[several], row[several], kind[several]
    start0, _, mark0, _ = unpacked(pack)
    start = start0[row] + order - begin[row]
    by = np.lexsort((start, doc[row], kind))
    gone = by[later(turns(kind[by]), doc[row[by]], start[by])]
    gone = gone[np.lexsort((start[gone], row[gone]))]
    at, a, b = united(row[gone], start[gone], start[gone] + WINDOW)
    return spans_as_records(doc[at], own[at], mark0[at], a, b)


def divided(key: np.ndarray, doc: np.ndarray, own: np.ndarray, pack: np.ndarray, texts: list[bytes], step: int) -> pa.RecordBatch:
    """The stretches of buckets as STRETCH rows with longer keys: windows whose distance from the core is in one run of `step` share
    a longer core."""
    bounds = np.cumsum([0, *map(len, texts)])
    piece = Piece(np.frombuffer(b"".join(texts), np.uint8), bounds)
    start, windows, mark, core = unpacked(pack)
    low = (core - windows + 1) // step
    count = core // step - low + 1
    row, nth = np.repeat(np.arange(len(texts)), count), ragged(low, count)
    begin = bounds[:-1][row]
    longer = begin + core[row] - nth * step
    first, last = np.maximum(begin, longer - step + 1), np.minimum(begin + windows[row] - 1, longer)
    keys = mixed(piece.hashes(longer, longer + WINDOW + 1 - step) ^ mixed(key[row].view(np.uint64) + nth.astype(np.uint64)))
    return stretches(piece, keys, doc[row], own[row], mark[row], start[row] + first - begin, first, last, longer)


def sorted_buckets(rows: DataFrame, step: int, most: int = MOST) -> DataFrame:
    """Spans, and the stretches of the buckets that are too large, divided, as STRETCH rows. rows: stretches sorted by key, hc, doc, pack
    and own."""

    def spans_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([b""] * len(columns[0]), pa.binary())], ["key", "hc", "doc", "own", "pack", "stretch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ghost = None  # the last first place
        held = large = None  # key, doc, own, pack, stretch of first places of unfinished work; a key that is set aside
        for batch in batches:
            key, hc, doc, own, pack = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
            start, windows, mark, _ = unpacked(pack)
            span = np.flatnonzero(windows == 0)
            if len(span):
                yield spans_of([x[span] for x in (key, hc, doc, own, pack)])
            at = np.flatnonzero(windows)
            if not len(at):
                continue
            some = [x[at] for x in (key, hc, doc, own, pack)]
            n = 0
            if ghost is not None:
                n, some = 1, [np.concatenate(x) for x in zip(ghost, some)]
            after, again, new = placed_first(*some)
            ghost = [x[np.flatnonzero(new)[-1:]] for x in some]
            gone = at[after[n:]]
            yield spans_of(spans_as_records(doc[gone], own[gone], mark[gone], start[gone], (start + windows - 1 + WINDOW)[gone]))
            at = at[~after[n:] & ~again[n:]]
            texts = batch.column(5).take(pa.array(at)).to_pylist()
            fresh = [key[at], doc[at], own[at], pack[at], texts]
            if large is not None:
                k = int(np.searchsorted(fresh[0], large, side="right"))
                if k:
                    yield divided(*(x[:k] for x in fresh), step)
                fresh = [x[k:] for x in fresh]
                if not len(fresh[0]):
                    continue
                large = None
            if held is not None:
                fresh = [*(np.concatenate(x) for x in zip(held[:4], fresh[:4])), held[4] + fresh[4]]
            held = fresh
            begin = np.flatnonzero(turns(held[0]))
            sizes = np.diff(np.append(begin, len(held[0])))
            over = sizes > most
            if not over.any() and sum(map(len, held[4])) < SORT_PIECE:
                continue
            each = np.repeat(over, sizes)
            if over.any():
                aside = np.flatnonzero(each)
                yield divided(*(x[aside] for x in held[:4]), [held[4][i] for i in aside], step)
            if over[-1]:
                large, last = held[0][-1], len(each)
            else:
                last = begin[-1]
            yield from self_sorted(held, np.flatnonzero(~each & (np.arange(len(each)) < last)))
            held = [x[last:] for x in held] if last < len(each) else None
        if held is not None:
            yield from self_sorted(held, np.arange(len(held[0])))

    def self_sorted(held: list, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(at):
            return
        key = held[0][at]
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[count[place] > 1]
        lengths = np.cumsum([len(held[4][i]) for i in at])
        edges = [0]
        key = held[0][at]
        for i in np.flatnonzero(key[1:] != key[:-1]) + 1:
            if lengths[i - 1] - (lengths[edges[-1] - 1] if edges[-1] else 0) >= SORT_PIECE:
                edges.append(int(i))
        for a, b in zip(edges, [*edges[1:], len(at)]):
            if b > a:
                part = at[a:b]
                yield spans_of(equal_windows(*(x[part] for x in held[:4]), [held[4][i] for i in part]))

    return rows.mapInArrow(run, STRETCH)


def repeated_spans(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc, own, mark, start, end: the byte spans to remove, which may overlap. docs: as keyed() has them."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(n, key).sortWithinPartitions(key, "hc", "doc", "pack", "own")

    def ends(rows: DataFrame) -> DataFrame:
        return rows.filter(windows_of() == 0).select("doc", "own", "pack", F.col("hc").alias("end"))

    marks = materialize(first_occurrences(dealt(records(docs), "hk")), "marks")
    wanted = marks.filter(windows_of() > 0).groupBy("doc", "own").agg(F.collect_set("pack").alias("packs"))
    spans, rows = marks.filter(windows_of() == 0), halves(docs, wanted.hint("merge"))
    for step in DIVISIONS:
        found = materialize(sorted_buckets(dealt(rows, "key"), step, most), "found")
        spans, rows = spans.unionByName(ends(found)), found.filter(windows_of() > 0)
    # in these buckets all strings are equal
    rows = rows.select(F.col("key").alias("hk"), "hc", "doc", "own", "pack")
    spans = spans.unionByName(first_occurrences(dealt(rows, "hk")).filter(windows_of() == 0))
    return spans.select("doc", "own", F.col("pack").bitwiseAND(0xFFFF).alias("mark"), F.shiftright("pack", 30).alias("start"), "end")


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and spans: array of mark, start and end."""
    spans = repeated_spans(docs).groupBy("doc", "own").agg(F.collect_list(F.struct("mark", "start", "end")).alias("spans"))
    return docs.join(spans.hint("merge"), ["doc", "own"], "left")


def text_mark(data: bytes) -> int:
    return int(Texts([data]).marks[0])


def kept_bytes(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, how much went, and in how many runs."""
    if not spans:
        return data, 0, 0
    mark = text_mark(data)
    own = sorted((s["start"], s["end"]) for s in spans if s["mark"] == mark)
    at, out, runs, gone = 0, [], 0, 0
    for a, b in own:
        if a > at or not runs:
            out.append(data[at:a])
            runs += 1
            at = a
        if b > at:
            gone += b - at
            at = b
    out.append(data[at:])
    return b"".join(out), gone, runs


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                left, gone, runs = kept_bytes(data, spans.as_py())
                rows.append((len(data), gone, runs, hashlib.sha256(left).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*rows))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(keyed(docs.select("doc_id", "text"))).select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))
