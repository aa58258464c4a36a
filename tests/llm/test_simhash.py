import itertools
import re

import numpy as np
import xxhash

from epochal.llm import simhash


def plain(text):
    lowered = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints):
    """doc_id of each component's least, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(prints))]


def test_whole_table(small):
    got = sorted(simhash.near_duplicates(small).collect())
    texts = {r.doc_id: r.text for r in small.collect()}
    assert [r.fingerprint for r in got] == [format(plain(texts[r.doc_id]), "016x") for r in got]
    assert [r.component_id for r in got] == components([(r.doc_id, int(r.fingerprint, 16)) for r in got])


def family(draw, n):
    """Fingerprints near a few others, in chains too."""
    fps = list(draw.integers(0, 2**63, 40, dtype=np.uint64))
    while len(fps) < n:
        x = int(fps[draw.integers(len(fps))])
        for b in draw.choice(64, draw.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        fps.append(np.uint64(x))
    return sorted(set(map(int, fps)))


def test_links_and_cells(spark):
    fps = family(np.random.default_rng(5), 1500)
    want = components([(k, x) for k, x in enumerate(fps)])
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    for cell, many in ((8, 4096), (4096, 4096), (4096, 0)):  # small cells set nearly all anchors aside; 0: two blocks
        roots = {r.node: r.root for r in simhash.components(simhash.found_links(nodes, cell, many)).collect()}
        signed = [int(np.uint64(x).view(np.int64)) for x in fps]
        label = [roots.get(x, x) for x in signed]
        groups, expected = {}, {}
        for k, (a, b) in enumerate(zip(label, want)):
            groups.setdefault(a, set()).add(k)
            expected.setdefault(b, set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_code_is_perfect():
    words = np.arange(1 << 15, dtype=np.uint64)
    near = simhash.nearest_codeword(words)
    assert len(np.unique(near)) == 1 << 11 and (np.bitwise_count(near ^ words) <= 1).all()


def test_anchors_are_complete():
    fp = np.random.default_rng(1).integers(0, 2**63, 1, dtype=np.uint64)
    keys = set(simhash.anchors(fp)[0].tolist())
    block = int(fp[0]) & (1 << 21) - 1
    code = {int(c) for c in np.unique(simhash.nearest_codeword(np.arange(1 << 15, dtype=np.uint64)))}
    want = {c | u << 15 for u in range(64) for c in code if bin((c | u << 15) ^ block).count("1") <= 2}
    assert {k for k in keys if k < 1 << 22} == want


def test_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and by[3].fingerprint == "0" * 16 and by[3].component_id == by[4].component_id == 3
    assert by[7].component_id == 6 and by[None].component_id is None
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 5), (False, 6), (False, 9), (False, 10), (False, 11), (True, None)]
    assert simhash.near_duplicates(none).count() == 0


def test_two_blocks_are_complete():
    fp = np.random.default_rng(2).integers(0, 2**63, 1, dtype=np.uint64)
    keys, _, home = simhash.anchors(fp, simhash.TWO)
    low = [k for k in keys.tolist() if k < 1 << 32]
    assert len(low) == len(set(low)) and home.sum() == 2
    block = int(fp[0]) & (1 << 32) - 1
    near = np.array(low, dtype=np.uint64)
    assert (np.bitwise_count(near ^ np.uint64(block)) <= 3).all() and not simhash.syndromes(near, 31).any()
    every = [block ^ sum(1 << b for b in bits) for n in range(4) for bits in itertools.combinations(range(32), n)]
    assert set(low) == {c for c in every if not simhash.syndromes(np.array([c], dtype=np.uint64), 31)[0]}


def test_comparisons_grow_with_the_fingerprints():
    """Pairs compared at anchors, in all: with two blocks nearly in proportion, with three by the square."""
    draw = np.random.default_rng(3)
    pairs = {}
    for scheme in (simhash.THREE, simhash.TWO):
        for n in (4000, 16000):
            key, _, home = simhash.anchors(draw.integers(0, 2**63, n, dtype=np.uint64), scheme)
            _, at = np.unique(key, return_inverse=True)
            pairs[scheme, n] = int((np.bincount(at)[at[home]] - 1).sum())
    assert pairs[simhash.TWO, 16000] < pairs[simhash.THREE, 16000] / 50


def test_one_star_and_a_chain(spark):
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots.get(i, i) == 0 for i in range(3000)) and all(roots.get(i, i) == 5000 for i in range(5000, 5201))


def test_which_row_stays(spark, odd):
    from pyspark.sql import functions as F

    rows = [("p", 2, "one text of five words"), ("q", 2, "one text of five words"), ("p", 2, "one text of five words"), ("r", None, "one text of five words")]
    docs = spark.createDataFrame(rows, "number string, doc_id long, text string")
    kept = [simhash.deduplicated(x).collect() for x in (docs, docs.repartition(3), docs.orderBy(F.desc("number")))]
    assert all(len(k) == 1 and k[0] == kept[0][0] for k in kept) and kept[0][0].number in ("p", "q")
