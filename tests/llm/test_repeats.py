import hashlib
import random

import numpy as np
import pytest

from epochal.llm import repeats, suffixes


def brute(rows):
    seen = {}
    for i, t in sorted(rows):
        for k in range(len(t) - 99):
            seen.setdefault(t[k : k + 100], (i, k))
    out = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if seen[t[k : k + 100]] < (i, k):
                gone[k : k + 100] = b"\1" * 100
        left = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(left).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removal(df).collect()}


def test_suffix_arrays():
    draw = np.random.default_rng(0)
    for _ in range(60):
        strings = [np.append(draw.integers(1, 2 + draw.integers(1, 4), draw.integers(0, 40)), 0) for _ in range(draw.integers(1, 6))]
        begin = np.cumsum([0, *(len(x) for x in strings[:-1])])
        got = suffixes.suffix_arrays(np.concatenate(strings), begin)
        for x, b in zip(strings, begin):
            t = x.tolist()
            assert (got[b : b + len(t)] - b).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_whole_table(small):
    want = brute([(r.doc_id, (r.text or "").encode()) for r in small.collect()])
    assert result(small) == want


@pytest.mark.parametrize("most", [2, 64])
def test_shifted_passages(spark, monkeypatch, most):
    """One passage, cut and changed at random places, so stretches are many and buckets large."""
    draw, words = random.Random(3), [f"w{i}é" for i in range(300)]
    passage = " ".join(draw.choice(words) for _ in range(120))
    rows = []
    for i in range(60):
        a, b = sorted(draw.sample(range(len(passage)), 2))
        own = " ".join(draw.choice(words) for _ in range(20))
        rows.append((i, own + passage[a:b] + own[::-1] + "ab" * draw.randint(0, 120)))
    plain = repeats.repeated_spans
    monkeypatch.setattr(repeats, "repeated_spans", lambda docs: plain(docs, most))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute([(i, t.encode()) for i, t in rows])


def test_odd(odd, none):
    got = repeats.removal(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[3].n_bytes == by[4].n_bytes == 0 and by[7].n_removed == by[7].n_bytes and by[6].n_removed > 0
    assert by[1].n_removed == 0  # equal rows don't remove each other
    assert repeats.removal(none).count() == 0


def test_one_id_two_texts(spark):
    draw = random.Random(1)
    a, b = ("".join(draw.choice("abcdefgh") for _ in range(150)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in repeats.removal(df).collect()) == [(1, 0), (2, 0), (2, 150)]


def by_row(rows):
    """As brute, by row: rows without an id share a place."""
    order = [(float("inf") if i is None else i, t.encode()) for i, t in rows]
    seen = {}
    for i, t in sorted(order):
        for k in range(len(t) - 99):
            seen[t[k : k + 100]] = min(seen.get(t[k : k + 100], (i, k)), (i, k))
    out = []
    for i, t in order:
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if seen[t[k : k + 100]] < (i, k):
                gone[k : k + 100] = b"\1" * 100
        out.append((len(t), sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def test_many_rows_without_an_id(spark):
    draw = random.Random(7)
    common = "".join(draw.choice("abcdefgh") for _ in range(400))
    rows = []
    for i in range(1000):
        a = draw.randint(0, 250)
        own = "".join(draw.choice("abcdefgh") for _ in range(150))
        rows.append((None, own + common[a : a + 150] if i % 3 else own + own))
    rows += [(5, common), (None, rows[0][1]), (None, rows[0][1])]
    got = repeats.removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == by_row(rows)


def test_equal_marks(spark):
    """The 16 bits that stand in a record aren't what tells texts apart."""
    draw, by_mark = random.Random(2), {}
    while True:
        text = "".join(draw.choice("abcdefgh") for _ in range(150))
        other = by_mark.setdefault(repeats.text_mark(text.encode()), text)
        if other != text:
            break
    rows = [(1, text), (None, text), (None, other)]
    got = repeats.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == by_row(rows)


def test_ids_that_are_strings(spark):
    draw = random.Random(1)
    a = "".join(draw.choice("abcdefgh") for _ in range(150))
    df = spark.createDataFrame([("b", a), ("a10", a), (None, a), ("a9", "x" + a)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in repeats.removal(df).collect()} == {"a10": 0, "a9": 150, "b": 150, None: 150}
