import itertools
import zlib

import numpy as np

from epochal.llm import langid


def test_marginals_are_exact():
    draw = np.random.default_rng(0)
    moves = draw.normal(size=(3, 3))
    lengths = np.array([1, 7, 70, 2])
    scores = draw.normal(size=(lengths.sum(), 3))
    got, at = langid.marginals(scores, moves, lengths), 0
    for n in lengths:
        s = scores[at : at + n]
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        a[0] = s[0]
        for t in range(1, n):
            a[t] = s[t] + np.logaddexp.reduce(a[t - 1][:, None] + moves, axis=0)
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(moves + (s[t + 1] + b[t + 1])[None, :], axis=1)
        m = np.exp(a + b - np.logaddexp.reduce(a[-1]))
        assert np.allclose(got[at : at + n], m)
        if n <= 7:
            total = np.zeros((n, 3))
            for y in itertools.product(range(3), repeat=int(n)):
                w = np.exp(sum(s[t, y[t]] for t in range(n)) + sum(moves[y[t - 1], y[t]] for t in range(1, n)))
                for t in range(n):
                    total[t, y[t]] += w
            assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_many_languages_in_bounded_memory():
    """100 languages: marginals as by lanes and by the plain recursion, in a few numbers per word and language."""
    import tracemalloc

    draw = np.random.default_rng(3)
    k, lengths = 100, np.array([40, 1, 0, 200, 33])
    scores, moves = draw.normal(size=(lengths.sum(), k)), draw.normal(size=(k, k))
    got, at = langid.marginals(scores, moves, lengths), 0
    for n in lengths[lengths > 0]:
        e, m = np.exp(scores[at : at + n]), np.exp(moves)
        a, b = [e[0] / e[0].sum()], [np.ones(k)]
        for t in range(1, n):
            a.append((a[-1] @ m) * e[t])
            a[-1] /= a[-1].sum()
            b.append(m @ (e[n - t] * b[-1]))
            b[-1] /= b[-1].sum()
        both = np.array(a) * np.array(b[::-1])
        assert np.allclose(got[at : at + n], both / both.sum(axis=1, keepdims=True))
        at += n
    lengths = np.full(256, 1_000)
    runs = list(langid.parts(lengths, langid.STATES // k))
    assert np.concatenate(runs).tolist() == list(range(256))
    longest = max(int(lengths[r].sum()) for r in runs)
    scores = draw.normal(size=(longest, k))
    tracemalloc.start()
    langid.marginals(scores, moves, lengths[runs[0]])
    langid.gradient(scores[:6144], moves, np.full(96, 64), np.zeros(6144, int))
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_runs_of_texts():
    assert [r.tolist() for r in langid.parts(np.array([0, 3, 4, 9, 0, 1, 2]), 7)] == [[1, 2], [3], [5, 6]]
    assert list(langid.parts(np.array([0, 0]), 7)) == list(langid.parts(np.array([], int), 7)) == []


def likelihood(scores, moves, lengths, truth):
    """Of the true languages, by the forward recursion in logarithms."""
    out, at = 0.0, 0
    for n in lengths:
        s, y = scores[at : at + n], truth[at : at + n]
        a = s[0]
        for t in range(1, n):
            a = s[t] + np.logaddexp.reduce(a[:, None] + moves, axis=0)
        out += s[np.arange(n), y].sum() + moves[y[:-1], y[1:]].sum() - np.logaddexp.reduce(a)
        at += n
    return out


def test_gradient_by_finite_differences():
    draw = np.random.default_rng(1)
    lengths = np.array([12, 1, 40, 2])
    scores, moves, truth = draw.normal(size=(55, 3)), draw.normal(size=(3, 3)), draw.integers(0, 3, 55)
    by_scores, by_moves = langid.gradient(scores, moves, lengths, truth)
    for array, found in ((scores, by_scores), (moves, by_moves)):
        for at in np.ndindex(array.shape):
            kept, sides = array[at], []
            for step in (1e-5, -1e-5):
                array[at] = kept + step
                sides.append(likelihood(scores, moves, lengths, truth))
            array[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-5 - found[at]) < 1e-6


def test_features_of_whole_words():
    """Words that differ after many letters, in their suffix or between."""
    stem = "donaudampfschifffahrtsgesellschaft"
    sets = [set(langid.features([w], langid.FEATURES)[0].tolist()) for w in (stem + "en", stem + "et", stem)]
    assert len(sets[0] - sets[1]) >= 4 and len(sets[0] - sets[2]) >= 4
    one = langid.Words(np.random.default_rng(0).normal(size=(langid.FEATURES, 2)))
    long = [one.number(w) for w in ("语" * 300_000, stem, "语" * 300_001)]
    got = one.emissions()[long]
    flat, count = langid.features([stem], langid.FEATURES)
    assert np.allclose(got[1], one.weights[flat].sum(axis=0)) and np.abs(got[0] - got[2]).max() > 1e-2


def test_every_language_is_learned(spark):
    """Also the ones of long documents only, and more than 64."""
    words = {f"l{i}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{'xyz'[k % 3]}{k}q".replace(str(k), chr(97 + k)) for k in range(20)] for i in range(70)}
    rows = [(i * 10 + j, " ".join(w * (2000 if i == 5 else 3)), name) for i, (name, w) in enumerate(words.items()) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.trained_on(docs).languages == sorted(words)


def test_names_that_clash(odd):
    from pyspark.sql import functions as F

    named = odd.withColumn("found_lang", F.lit("x")).withColumn("__lang", F.lit("y")).withColumn("FOUND_SCORE", F.lit("z"))
    out = langid.accepted(named)
    assert out.columns == named.columns and {(r.found_lang, r["__lang"], r.FOUND_SCORE) for r in out.collect()} == {("x", "y", "z")}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_change_nothing(spark, small):
    from pyspark.sql import functions as F

    other = small.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda df: sorted(map(tuple, langid.identified(df).collect()))
    assert key(small) == key(other)


def test_switching(spark, small):
    rows = {r.lang: r.text for r in small.filter("n_chars > 2000").collect()}
    mixed = [(1, " ".join(rows["en"].split()[:60] + rows["de"].split()[:20]), None)]
    extra = spark.createDataFrame(mixed, "doc_id long, text string, lang string")
    r = langid.predicted(extra, langid.trained_on(small)).first()
    assert r.lang_pred == "en" and 0.6 < r.score < 0.9


def test_odd(spark, odd, none):
    got = {r.doc_id: r for r in langid.identified(odd).collect()}
    assert len(langid.identified(odd).collect()) == odd.count()
    for i in (3, 4, 5):
        assert (got[i].lang_pred, got[i].score) == ("und", 0)
    assert got[2].lang_pred in ("de", "en") and got[6].lang_pred == "en"
    assert langid.identified(none).count() == 0
    unlabelled = odd.withColumn("lang", odd.lang.substr(100, 1)).filter("lang is null")
    assert {r.lang_pred for r in langid.identified(unlabelled).collect()} <= {"und"}
