import hashlib
from collections import defaultdict

import numpy as np
import pytest
from tests import oracle

from epochal.llm import lines
from epochal.llm.common import new_path

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(STRIP).translate(LOWER)


def brute(rows):
    """(doc_id, n_lines, n_dropped, digest of what stays) by plain Python; rows are (doc_id, text)."""
    holders = defaultdict(list)
    for at, (_, text) in enumerate(rows):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(at)
    size = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    last = {k: rows[max(v, key=size)][0] for k, v in holders.items() if len(v) >= 3}
    out = []
    for doc_id, text in rows:
        whole = (text or "").split("\n")
        kept = [line for line in whole if key(line) not in last or last[key(line)] == doc_id]
        out.append((doc_id, len(whole), len(whole) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()), key=repr)


def some(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    common = [f"  Some Line That Repeats É {i} \r" for i in range(12)] + ["short", "", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"]
    rows = [(int(i), "\n".join([*rng.choice(common, rng.integers(0, 8)), f"a line of document {i} alone"])) for i in range(n)]
    rows[3] = (3, None)
    rows[4] = (4, "")
    rows[5] = (4, rows[6][1])
    rows += [rows[7], rows[7], (None, "\n".join(common)), (None, common[0].upper()), (None, "x" * 30)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_equals_sql(spark):
    for data in ("/root/testdata/sf0.001", oracle.DATA):
        oracle.check(spark, oracle.connect(data), lines.op11_line_dedup, lines.op11_sql(), data)


def test_brute_force(spark):
    rows, docs = some(spark)
    assert ours(lines.deduplicated(docs)) == brute(rows)


def test_odd(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    three = odd.unionByName(odd).unionByName(odd)
    assert ours(lines.deduplicated(three)) == brute(rows * 3)
    assert lines.deduplicated(three).columns == [*odd.columns, "n_lines", "n_dropped"]
    assert not lines.deduplicated(none).collect()
    clash = odd.withColumn("n_lines", odd.size).withColumn("drops", odd.size)
    assert lines.deduplicated(clash).columns == [*clash.columns, "_n_lines", "n_dropped"]


def counts(index):
    return sorted(tuple(r) for r in index.counts().collect())


def test_insertions_and_deletions(spark):
    """In any order, the index is that of the documents that are left."""
    rows, _ = some(spark, 40)
    docs = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    first, second = rows[:25], rows[25:]
    index = lines.LineIndex(spark, new_path(spark, "test"))
    index.insert(docs(first), 1)
    before = counts(index)
    index.insert(docs(second), 3)
    assert ours(index.cleaned(docs(rows))) == brute(rows)
    index.delete(docs(second))
    assert counts(index) == before and index.live == len(before)
    keepers = first[-5:]
    index.delete(docs(keepers))
    index.delete(docs(keepers))  # no longer there
    index.delete(docs([(77, rows[0][1])]))
    left = first[:-5]
    assert ours(index.cleaned(docs(left))) == brute(left)
    index.insert(docs(keepers + second), 1)
    again = lines.LineIndex(spark, index.folder)
    assert ours(again.cleaned(docs(rows))) == brute(rows)


def test_filters_hold_the_live_keys(spark):
    rows, docs = some(spark)
    index = lines.LineIndex(spark, new_path(spark, "test"))
    index.insert(docs)
    index.delete(docs.filter("doc_id < 30"))
    filters = {r.shard: lines.Cuckoo(r.slots, r.stash) for r in index.filters().collect()}
    live = counts(index)
    hi, lo = np.array([r[:2] for r in live], np.int64).T
    assert list(filters) == [0] and filters[0].holds(hi, lo).all()
    assert (filters[0].slots > 0).sum() + len(filters[0].stash) == len(live) == index.live


def test_false_positives(spark, monkeypatch):
    """Keys that a filter holds by chance are looked up, found missing, and count as new."""
    from pyspark.sql import functions as F

    rows, docs = some(spark)
    monkeypatch.setattr(lines, "asked", lambda keys, filters, bits: keys.withColumn("maybe", F.lit(True)))
    assert ours(lines.deduplicated(docs)) == brute(rows)


def test_more_shards(spark, monkeypatch):
    """When the filters become too few they are built anew from the exact counts."""
    rows, docs = some(spark)
    monkeypatch.setattr(lines, "LOAD", 1e-5)
    index = lines.LineIndex(spark, new_path(spark, "test"))
    index.insert(docs.limit(5), 1)
    few = index.bits
    index.insert(docs.limit(0), 1)
    index.insert(spark.createDataFrame(rows[5:], docs.schema), 2)
    assert index.bits > few and index.filters().count() > 1
    assert ours(index.cleaned(docs)) == brute(rows)


def test_broken_attempt(spark):
    rows, docs = some(spark)
    index = lines.LineIndex(spark, new_path(spark, "test"))
    index.insert(docs, 1)
    for name in ("references", "counts", "filters"):
        spark.range(3).write.parquet(f"{index.folder}/{name}/version=2")
    index = lines.LineIndex(spark, index.folder)
    assert index.version == 1
    index.insert(docs.limit(0), 1)
    assert ours(index.cleaned(docs)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 1000, 200_000])
def test_cuckoo(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(-(2**62), 2**62, (2, n))
    cuckoo = lines.Cuckoo()
    cuckoo.add(hi, lo)
    assert cuckoo.holds(hi, lo).all() and len(cuckoo.stash) <= n / 1000
    half = n // 2
    cuckoo.remove(hi[:half], lo[:half])
    cuckoo = lines.Cuckoo(cuckoo.slots.tobytes(), cuckoo.stash)
    assert cuckoo.holds(hi[half:], lo[half:]).all()
    assert (cuckoo.slots > 0).sum() + len(cuckoo.stash) == n - half
    assert n < 1000 or cuckoo.holds(hi[:half], lo[:half]).mean() < 0.01


def test_cuckoo_of_equal_marks():
    """More equal fingerprints than two buckets hold go to the stash, and leave it again."""
    hi, lo = np.full(20, 5), np.full(20, 9)
    cuckoo = lines.Cuckoo()
    cuckoo.add(hi, lo)
    assert (cuckoo.slots > 0).sum() == 8 and len(cuckoo.stash) == 12
    cuckoo.remove(hi, lo)
    assert not cuckoo.slots.any() and not cuckoo.stash and not cuckoo.holds(hi, lo).any()
