import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from epochal.llm import mixing


def levels(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3 * sizes[s] for s in over}


def test_law(small):
    got = mixing.mixed(small).join(small.select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = levels(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 4 * mixing.BLOCK_WORDS)


def test_reruns_agree(small):
    key = lambda: sorted(map(tuple, mixing.mixed(small.repartition(5)).select("doc_id", "taken").collect()))
    assert key() == key()


def test_caps_reshared(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 90_000), ("b", 300), ("c", 600), (None, 5000), ("é", 100)])]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = levels({s: len(t) // 2 for _, t, s in rows})
    assert {r.doc_id: pytest.approx(r.target) for r in got} == {i: want[s] for i, _, s in rows}
    assert all(r.taken <= 3 * r.size for r in got)


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 100, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("to"))
        assert sorted(r.to for r in df.collect()) == list(range(n))


def test_shards_differ_and_sum_to_quota(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 64)
    rows = [(i, "w " * 500, f"s{i % 3}") for i in range(60)]
    sizes = mixing.counted(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sources = mixing.targets(sizes)
    plan = mixing.mix_plan(sources).collect()
    quota = {r.key: r.slots for r in sources.collect()}
    assert Counter(r.key for r in plan) == quota
    assert all(1 <= r.cut <= mixing.BLOCK_WORDS for r in plan if r.cut)
    per = defaultdict(Counter)
    for r in plan:
        per[r.shard][r.key] += 1
    assert len({tuple(sorted(c.items())) for c in per.values()}) > 1


def test_odd(odd, none):
    got = mixing.mixed(odd).collect()
    assert len(got) == odd.count()
    assert all(r.taken == 0 for r in got if r.doc_id in (3, 4))
    out = mixing.resampled(odd)
    assert out.columns == odd.columns
    most = Counter(r.doc_id for r in out.collect())
    assert most[6] <= 3 and 3 not in most
    assert mixing.mixed(none).count() == 0 and mixing.resampled(none).count() == 0


def totals(rows):
    out = Counter()
    for source, n in rows:
        out[source] += n
    return out


def test_small_sources_come_near_their_targets(spark, small):
    """Sources that are less than a block, and many that end in a short block."""
    for sizes in ([100, 60, 20], [1, 1, 1], [127, 128, 129, 255, 256, 257, 1000], [5000, 300, 40, 7]):
        rows = [(100 * k + j, "w " * (n - n // 3 if j else n // 3), f"s{k}") for k, n in enumerate(sizes) for j in range(2)]
        got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        taken, target = totals((r.source, r.taken) for r in got), {r.source: r.target for r in got}
        assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and all(r.taken <= 3 * r.size for r in got)
    got = mixing.mixed(small).collect()
    taken, target = totals((r.source, r.taken) for r in got), {r.source: r.target for r in got}
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_inverse_permutation(spark):
    df = spark.range(100).select(mixing.permuted(mixing.permuted(F.col("id"), F.lit(100).cast("long"), F.lit(3)), F.lit(100).cast("long"), F.lit(3), inverse=True).alias("back"))
    assert [r.back for r in df.collect()] == list(range(100))


def test_whole_documents_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = {r.source: r.target for r in mixing.mixed(docs).collect()}
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    out = totals((r.source, words(r.text)) for r in mixing.resampled(docs).collect())
    largest = {}
    for r in docs.collect():
        largest[r.source] = max(largest.get(r.source, 0), words(r.text))
    for s in target:
        assert abs(out[s] - target[s]) <= max(0.02 * target[s], largest[s])


def test_names_that_clash(spark, odd):
    named = odd.withColumn("id", F.lit("x")).withColumn("times", F.lit("y")).withColumn("COPY", F.lit("z"))
    out = mixing.resampled(named)
    assert out.columns == named.columns and {(r.id, r.times, r.COPY) for r in out.collect()} == {("x", "y", "z")}


def test_sources_without_words(spark):
    """Null, empty and blank texts, with and without another source, and no words at all."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    blank = [(1, None, "z"), (2, None, "z"), (3, "", "y"), (4, " \t\n", "x"), (5, None, None)]
    for docs in (blank, [*blank, (6, "one two three", "a")]):
        got = {r.doc_id: r for r in mixing.mixed(frame(docs)).collect()}
        assert len(got) == len(docs)
        assert all((got[i].size, got[i].source_size, got[i].target, got[i].taken) == (0, 0, 0.0, 0) for i in range(1, 6))
        assert len(docs) == 5 or (got[6].target, got[6].taken) == (3.0, 3)
        assert sorted(r.doc_id for r in mixing.resampled(frame(docs)).collect()) == [6] * (len(docs) - 5)


def test_draws_do_not_depend_on_the_order_of_rows(spark):
    """Rows of one doc_id and source, some of them equal in everything, in other orders and partitions."""
    rows = [(i % 3, "w " * (20 + i % 2), f"s{i % 2}", {"a": i % 4}) for i in range(60)] + [(7, "x " * 900, "s2", {"a": 1})] * 5
    made = []
    for order, parts in ((rows, 1), (rows[::-1], 3), (rows[20:] + rows[:20], 7)):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, more map<string,int>").repartition(parts)
        made.append(sorted((r.doc_id, r.text, r.source, r.more["a"]) for r in mixing.resampled(docs).collect()))
    assert made[0] == made[1] == made[2] and made[0]
    size, out = Counter(), Counter()
    for i, t, s, _ in rows:
        size[s] += t.count(" ")
    for i, t, s, _ in made[0]:
        out[s] += t.count(" ")
    want = levels(size)
    assert all(abs(out[s] - want[s]) <= 900 for s in size)
