import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests import oracle

from epochal.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def is_near(x, y):
    """One edit, by trying them all."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(words):
    out = []
    form = {}
    for w, n in words.items():
        near = [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out.append((w, n, len(near)))

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, k, form[w] and words[form[w]]) for w, n, k in out), key=repr)


def ours(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    oracle.check(spark, oracle.connect(data), spelling.op13_spelling, spelling.op13_sql(), data)


@pytest.mark.parametrize("tile", [2, 8, 128])
def test_brute_force(spark, monkeypatch, tile):
    """Words over few letters, so that blocks are large and must be divided down to windows of one position."""
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(tile)
    made = ["".join(rng.choice(list("abÀÉ"), rng.integers(6, 8))) for _ in range(600)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    docs = [(i, " ".join(w for w in rng.choice(made, 200) for _ in range(int(rng.choice([1, 2, 30])))).upper() + " Ünïcödé×÷ x1yĀabcdef") for i in range(60)]
    docs += [(None, " ".join(made)), (3, None), (4, ""), (5, "12 .."), docs[0], docs[0]]
    words = words_of(docs)
    got = ours(spelling.variants(frame(spark, docs)))
    assert len(got) > 300 and got == brute(words)


def test_chains(spark):
    """Forms are followed to the last."""
    docs = [(-1, " ".join(w for w, n in (("steamer", 5), ("steamar", 25), ("steamal", 125), ("steemal", 625), ("stiemal", 3125)) for _ in range(n)))]
    got = {r.word: r.root for r in spelling.variants(frame(spark, docs)).collect()}
    assert brute(words_of(docs)) == ours(spelling.variants(frame(spark, docs)))
    assert got["steamer"] == got["steemal"] == "stiemal"


def test_long_words(spark):
    """Letters without a space, at any length."""
    long = "ab" * 20_000
    docs = [(i, " ".join([long, long[:-1], long[:777] + "z" + long[778:], "b" + long, "short", "letters"])) for i in range(7)]
    assert ours(spelling.variants(frame(spark, docs))) == brute(words_of(docs))


def test_odd(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert ours(spelling.variants(odd)) == brute(words_of(rows))
    assert not spelling.variants(none).collect()
    assert not spelling.variants(frame(spark, [(1, "few words here")])).collect()


def test_blocks_find_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 3)
    rng = np.random.default_rng(0)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(6, 8))) for _ in range(300)})
    rows = spelling.blocked(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    found = Counter()
    blocks = {}
    for r in rows.collect():
        blocks.setdefault((r.m, r.a, r.b, r.block), []).append(r)
    for (m, a, b, _), members in blocks.items():
        at = np.array([[m, a, b]] * len(members)).T
        texts = [r.word for r in members]
        for p, q in spelling.near_pairs([w.encode("latin-1") for w in texts], *at, np.array([0, len(texts)])).T:
            found[texts[p], texts[q]] += 1
    assert found == Counter({(x, y): 1 for x in words for y in words if x != y and abs(len(x) - len(y)) < 2 and is_near(x, y)})
    assert max(len(v) for k, v in blocks.items() if k[2] - k[1] > 1) <= 3
