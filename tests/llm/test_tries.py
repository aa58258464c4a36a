import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import oracle

from epochal.llm import tries

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    """The trie of (conv_id, turn, role, text) by plain Python."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            t = hashlib.sha256(f"0:{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), t, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(made) + 1):
            nodes[tuple(made[:d])].append((c, d == len(made)))
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    name = {p: min(c for c, _ in v) for p, v in nodes.items()}
    ends = lambda v: hashlib.sha256(",".join(str(c) for c, e in sorted(v) if e).encode()).hexdigest()
    return sorted(((name[p], len(p), name[p[:-1]] if p else None, len(v), kids[p], leaves[p], saved[p], ends(v)) for p, v in nodes.items()), key=repr)


def ours(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def some(seed=0, convs=60):
    """Conversations with nulls, ties, repeated rows, negative ids, shared turns, and one of 500 turns."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(-7, convs), 10**12, 10**12 + 3]:
        if rng.random() < 0.15:
            continue
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["yes", "no", "é 🙂"])) if rng.random() < 0.8 else f"text {c} {t}"))
    rows += [(20, t, "user", f"turn {t % 7}") for t in range(500)] + [(21, t, "user", f"turn {t % 7}") for t in range(500)]
    rows += [(5, None, "user", "before all"), (5, None, None, None), (6, 1, None, "x"), (6, 1, "user", None), rows[3], rows[3], (None, 1, "user", "nobody"), (1000, 0, "user", "")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_equals_sql(spark):
    for data in ("/root/testdata/sf0.001", oracle.DATA):
        oracle.check(spark, oracle.connect(data), tries.op12_prefix_trie, tries.op12_sql(), data)


@pytest.mark.parametrize("seed", [0, 1])
def test_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(tries, "BLOCK", 3)
    monkeypatch.setattr(tries, "PIECE", 2)
    rows = some(seed)
    clash = frame(spark, rows).repartition(5).select("*", *(F.lit(7).alias(c) for c in ("c", "t", "d", "product", "part", "i", "bytes", "at")))
    assert ours(tries.trie(clash)) == brute(rows)


def test_conversation_over_several_parts(spark):
    """Products of one conversation that lies in all parts are composed."""
    rows = [(20, t, "user", f"turn {t % 11}") for t in range(4000)] + [(21, t, "user", f"turn {t % 11}") for t in range(3000)]
    parts = tries.products(frame(spark, rows), 0).select("part").distinct().count()
    assert parts > 3
    got = tries.trie(frame(spark, rows))
    assert got.agg(F.max("depth"), F.count("*")).first()[:] == (4000, 4001)
    assert got.filter("depth = 3000").select("n_convs", "n_children", "n_leaves").first()[:] == (2, 1, 1)
    assert got.filter("depth = 0").first().saved_tokens == sum(len(f"turn {t % 11}") for t in range(3000))


def test_many_members(spark):
    """One node with all conversations, and a root at which many end."""
    rows = [(c, t, "user", "hello") for c in range(3000) for t in range(2)]
    assert ours(tries.trie(frame(spark, rows))) == brute(rows)


def test_collisions(spark, monkeypatch):
    """Turns with one element and two texts are found, and all is done again with other elements."""
    proper, seeds = tries.element, []

    def weak(seed):
        seeds.append(seed)
        return F.unhex(F.lpad(F.hex(F.length(F.coalesce("text", F.lit("")))), 32, "0")).alias("t") if seed == 0 else proper(seed)

    monkeypatch.setattr(tries, "element", weak)
    rows = [r for r in some(2, 20) if r[0] != 6]
    rows = [r for r in rows if r[1] is not None]
    seen = set()
    rows = [r for r in rows if (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))]
    assert ours(tries.trie(frame(spark, rows))) == brute(rows)
    assert set(seeds) == {0, 1}


def test_empty(spark):
    assert not tries.trie(frame(spark, [])).collect()
    assert not tries.trie(frame(spark, [(None, 0, "user", "x")])).collect()
    (root,) = tries.trie(frame(spark, [(2, 0, "user", "x")])).collect() if zlib.crc32(b"2") % 9 else [None]
    assert root is None or (root.depth, root.n_convs, root.n_leaves, root.ends_sha256) == (0, 1, 1, hashlib.sha256(b"2").hexdigest())
