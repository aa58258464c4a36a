"""Class indices as bitmaps, and the channels that a study has."""

from pyspark.sql import functions as F

from epochal.operators import bitmaps, channels, labels
from epochal.sources import tables
from tests import oracle
from tests.test_archive import plan


def lists(index, *keys):
    rows = index.select(*keys, F.explode(bitmaps.numbers(F.col("bits"), F.col("bucket"))).alias("x")).collect()
    assert len(rows) == index.agg(F.sum("n")).first()[0]
    found = {}
    for r in rows:
        found.setdefault(tuple(r[:-1]), []).append(r.x)
    return {k: sorted(v) for k, v in found.items()}


def test_same_as_lists_in_less(spark):
    periods = tables.periods(spark, oracle.DATA)
    index = bitmaps.class_bitmaps(periods)
    plain = labels.class_index(periods)
    assert lists(index, "study_id", "stage") == {(r.study_id, r.stage): r.indices for r in plain.collect()}
    size = index.agg(F.sum(F.length("bits"))).first()[0]
    assert size < plain.agg(F.sum(F.size("indices") * 4)).first()[0]
    assert "collect" not in plan(index).lower()


def test_several_buckets(spark):
    """Numbers at the edges of bytes and buckets, repeated ones, nulls, and a class without any."""
    held = {1: [0, 7, 8, 32767, 32768, 70000], 2: [5], 3: [32768]}
    rows = [(1, c, i) for c, x in held.items() for i in x * 2] + [(1, 4, None)]
    periods = spark.createDataFrame(rows, "study_id long, stage int, period_idx int")
    index = bitmaps.class_bitmaps(periods)
    assert lists(index, "stage") == {(c,): x for c, x in held.items()}
    assert index.filter("stage = 1").count() == 3
    assert bitmaps.class_bitmaps(periods.limit(0)).count() == 0


def test_merged_without_periods(spark):
    periods = tables.periods(spark, oracle.DATA).select("study_id", "stage", "period_idx")
    parts = [bitmaps.class_bitmaps(periods.filter(F.col("period_idx") % 3 == k)) for k in range(3)]
    both = bitmaps.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[0]), "study_id", "stage")
    key = lambda df: sorted((r.study_id, r.stage, r.bucket, bytes(r.bits), r.n) for r in df.collect())
    assert key(both) == key(bitmaps.class_bitmaps(periods))


def test_studies_over_buckets(spark):
    has = {3: {0, 1}, 32767: {0}, 32768: {0, 1}, 10**9: {0, 1, 2}, 10**9 + 1: {1, 2}}
    rows = spark.createDataFrame([(s, c) for s, cs in has.items() for c in cs for _ in range(3)], "study_id long, stage int")
    index = bitmaps.studies_by_class(rows)
    for asked in ([0, 1], [0], [0, 1, 2], [1, 2], [7], [0, 7]):
        assert sorted(r.study_id for r in bitmaps.having(index, asked).collect()) == sorted(s for s, c in has.items() if c >= set(asked))


def test_references_that_are_there(spark):
    rows = [(["C3", "C4", "A1", "A2"], ["C3-A2", "C4-A1"]), (["C3", "A1"], ["C3"]), (["E1", "o2", "m1"], ["E1", "o2-m1"]), (["A1"], []), ([], []), (["C3", None, "M2"], ["C3-M2"])]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(rows)], "i int, names array<string>")
    got = {r.i: r.l for r in df.select("i", channels.referenced(F.col("names")).alias("l")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_choices_of_groups(spark):
    rows = [([["a", "b"], ["b", "a"]], ["ab", "aa", "bb"]), ([["a"], []], []), ([["c"], ["a", "b"], ["a"]], ["caa", "cba"]), ([["a", "a"], ["b"]], ["ab"]), ([], [""])]
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(rows)], "i int, groups array<array<string>>")
    got = {r.i: ["".join(c) for c in r.c] for r in df.select("i", channels.combinations(F.col("groups")).alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}
