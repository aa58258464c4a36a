"""Spelling variants by dense prefix-suffix tiling.

Words are counted over the corpus, and words that differ by one inserted, deleted or replaced code point are found in blocks. A pair's
base length m is the length of its shorter word. A block has a window [a, b) of base positions: its words agree in the a code
points before the window and in the m - b ones after it, so they can differ within the window alone. The windows [0, m / 2) and
[m / 2, m) hold every pair in exactly one block, that of the window in which the words first differ. Blocks of more than TILE words are
divided by halving their window, as often as needed; a window of one position can't be divided, but bounds its block by the
alphabet. So no step compares all pairs of a large group, and none is left out.

Blocks are packed into tensors of padded code-point matrices, left-aligned and right-aligned, and compared word by word at once: two
words are near if the lengths of their common prefix and common suffix together reach the longer length minus one.

Defined cases: a null text has no words; the digits of a null doc_id are the empty string; repeated rows are documents of their own; of near
words of equal frequency the first in code-point order is taken; words may be of any length; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm.common import discard, materialize, salted_join, spread, table
from epochal.llm.tries import crc32_sql

MIN_POINTS, MIN_COUNT, TIMES, DAMAGE = 6, 5, 5, 199
#: Words of at least MIN_POINTS letters, in texts whose A-Z are lower-cased; all letters are Latin-1, so a code point is a byte.
LETTERS = re.compile(r"[a-zÀ-ÿ]{%d,}" % MIN_POINTS)
#: Words of a block that is compared as it is; words counted before a task hands them on; bytes of a tensor.
TILE, HELD, CELLS = 128, 400_000, 1 << 22


def counted(docs: DataFrame) -> DataFrame:
    """word, n: of all words with enough code points and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                    for word, n in Counter(LETTERS.findall((text or b"").lower().decode())).items():
                        code = zlib.crc32(word.encode(), start)
                        if code % DAMAGE == 0:
                            at = code % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < MIN_POINTS:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield out()
                    total.clear()
        yield out()

    rows = spread(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def in_window(a: Column, b: Column) -> Column:
    """The block of a word for a window: a hash of what the words of a block share. Words that share a hash alone are compared in
    vain."""
    return F.xxhash64("m", a, b, F.expr("substring(word, 1, a)"), F.expr("right(word, m - b)")).alias("block")


def blocked(words: DataFrame) -> DataFrame:
    """word, n, m, a, b, block: the rows of all blocks that hold a pair, each with at most TILE rows or a window of one position."""
    length = F.length("word")
    bases = F.explode(F.when(length > MIN_POINTS, F.array(length, length - 1)).otherwise(F.array(length)))
    rows = words.select("word", "n", bases.alias("m"))
    halves = lambda a, b: F.explode(F.array(F.struct(a.alias("a"), F.floor((a + b) / 2).cast("int").alias("b")), F.struct(F.floor((a + b) / 2).cast("int").alias("a"), b.alias("b"))))
    rows, found, same = rows.withColumn("w", halves(F.lit(0), F.col("m"))).select("word", "n", "m", "w.*"), [], ["m", "a", "b", "block"]
    while True:
        rows = materialize(rows.withColumn("block", in_window(F.col("a"), F.col("b"))), "blocked")
        short = F.length("word") == F.col("m")
        sizes = rows.groupBy(*same).agg(F.count(F.when(short, 1)).alias("shorts"), F.count("*").alias("all")).filter("shorts > 0 and `all` > 1")
        sized = materialize(salted_join(rows, sizes, same, "word"), "sized")
        discard(rows)
        done = (F.col("all") <= TILE) | (F.col("b") - F.col("a") == 1)
        found.append(sized.filter(done).select("word", "n", *same))
        rows = sized.filter(~done).withColumn("w", halves(F.col("a"), F.col("b"))).select("word", "n", "m", "w.*")
        if not rows.head(1):
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, left-aligned and right-aligned from the end, padded with zeros, and the lengths."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.zeros((len(words), size.max()), np.uint8), np.zeros((len(words), size.max()), np.uint8)
    left[row, at] = flat
    right[row, np.repeat(size, size) - 1 - at] = flat
    return left, right, size


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading cells of the last axis are equal."""
    differs = x != y
    return np.where(differs.any(-1), differs.argmax(-1), x.shape[-1])


def near_pairs(words: list[bytes], m: np.ndarray, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row numbers (of a word, of a near word), in both directions, of pairs that first differ within their block's window. starts: where
    the blocks begin, and the number of rows."""
    left, right, size = matrices(words)
    width, sizes, out = left.shape[1], np.diff(starts), []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        """Rows i (blocks x s) with rows j (blocks x t); -1 is no row."""
        x, y = i[:, :, None], j[:, None, :]
        first = common(left[x], left[y])
        longest = np.maximum(size[x], size[y])
        window = (a[x] <= first) & ((first < b[x]) | (first == m[x]) & (b[x] == m[x]))
        hit = (x >= 0) & (y >= 0) & (x != y) & window & (size[x] == m[x]) & (first + common(right[x], right[y]) >= longest - 1)
        block, s, t = np.nonzero(hit)
        p, q = i[block, s], j[block, t]
        out.append(np.stack([p, q]))
        longer = size[q] > size[p]  # words of equal length meet twice
        out.append(np.stack([q[longer], p[longer]]))

    most = max(1, CELLS // width)
    for s in sorted({1 << int(k - 1).bit_length() for k in np.unique(sizes)}):
        of = np.flatnonzero((sizes <= s) & (sizes > s // 2))
        if s * s > most:  # one block at a time, in strips
            for k in of:
                rows = np.arange(starts[k], starts[k + 1])
                step = max(1, most // len(rows))
                across = max(1, min(len(rows), most // step))
                for u in range(0, len(rows), step):
                    for v in range(0, len(rows), across):
                        compare(rows[None, u : u + step], rows[None, v : v + across])
            continue
        for u in range(0, len(of), max(1, most // (s * s))):
            k = of[u : u + max(1, most // (s * s))]
            rows = starts[k][:, None] + np.arange(s)
            rows[np.arange(s) >= sizes[k][:, None]] = -1
            compare(rows, rows)
    return np.concatenate(out, axis=1)


def best_near(rows: DataFrame) -> DataFrame:
    """word, n_near, more (the negative frequency of its best near word), near: of all words with a near word."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = ["m", "a", "b", "block"]

    def tiled(batch: pa.Table) -> pa.RecordBatch:
        m, a, b, block, freq = (batch.column(c).to_numpy() for c in ("m", "a", "b", "block", "n"))
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        turn = (m[1:] != m[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (block[1:] != block[:-1])
        starts = np.r_[0, np.flatnonzero(turn) + 1, len(m)]
        p, q = near_pairs(words, m, a, b, starts)
        _, rank = np.unique(np.array(words, object), return_inverse=True)
        order = np.lexsort((rank[q], -freq[q], rank[p]))
        p, q = p[order], q[order]
        first = np.flatnonzero(np.r_[True, rank[p][1:] != rank[p][:-1]][: len(p)])
        many = np.diff(np.r_[first, len(p)])
        text = lambda at: pa.array([words[i].decode("latin-1") for i in at], pa.string())
        return pa.RecordBatch.from_arrays([text(p[first]), pa.array(many, pa.int64()), pa.array(-freq[q[first]], pa.int64()), text(q[first])], ["word", "n_near", "more", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            keys = [rows.column(c).to_numpy() for c in same]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)) if len(rows) else []
            whole = int(last[-1]) + 1 if len(last) else 0  # blocks but the last one, which may go on
            if whole:
                yield tiled(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        rows = pa.Table.from_batches(held) if held else []
        if len(rows):
            yield tiled(rows)

    dealt = rows.repartition(n, *same).sortWithinPartitions(*same)
    found = dealt.mapInArrow(run, "word string, n_near long, more long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("more", "near")).alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word."""
    words = materialize(counted(docs), "words")
    near = best_near(blocked(words))
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.more")).alias("near_n"))
    good = F.col("near_n") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n"))
    rows = materialize(rows, "variants")
    # each step follows as many forms again as all steps before; frequencies grow TIMES fold along forms, so chains are short
    roots = materialize(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(salted_join(roots, further, ["root"], "word", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        discard(roots)
        roots = moved.select("word", "root")
        if not moved.filter("next is not null").head(1):
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op13_sql() -> str:
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT *, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM lowered WHERE length(run) >= 6),
made AS (SELECT CASE WHEN h % 199 = 0 THEN concat(run[1:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, p, concat(word[1:p], word[p + 2:]) AS rest FROM (SELECT word, unnest(range(length(word))) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = rest UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = rest),
known AS (SELECT pairs.word, near, w.n, v.n AS near_n FROM pairs JOIN words w ON w.word = pairs.word JOIN words v ON v.word = near),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM known GROUP BY word),
formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
climbed AS (SELECT word, word AS root, 0 AS steps FROM formed UNION ALL SELECT climbed.word, form, steps + 1 FROM climbed JOIN formed ON formed.word = climbed.root WHERE form IS NOT NULL),
roots AS (SELECT word, last(root ORDER BY steps) AS root FROM climbed GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""
