"""Conversation prefix tries by composable monoid fingerprints.

Every conversation is rebuilt as the first h turns of its base conversation followed by its own turns after its first h. No rebuilt text
is made. A turn's element is a digest of its role and text; sequences of turns form a monoid of pairs (length, hash), where
(k1, a1) . (k2, a2) = (k1 + k2, a1 * R ** k2 + a2) modulo a prime. The product over the first i turns of every stored conversation is
computed once, in chunks that are composed; the prefix of a rebuilt conversation is then the base's product up to h times the quotient
of two products of its own. Prefixes of equal depth and product are a node.

Nodes are verified: all members of a node must have the same last element (so, dividing by it, the same product before it, and by
induction the same elements), and where the members of a node refer to different stored turns, all stored turns of that element must
have one role and one text. Should that fail, everything is done again with other elements.

A node is named by its smallest member, which is also the smallest member of all nodes below it on its path. So a conversation names a
chain of nodes, sums over subtrees are sums over members of whole chains plus a piece of the node's own chain, and nothing is
iterated over depths. Chains and conversations are summed in blocks, members of one node are grouped with partial sums, and the ids for a
node's digest are joined in sorted pieces, so no task needs a node or a conversation whole.

Defined cases: turns without conversation take no part; a null turn comes first; turns of equal number follow in the order of their
elements, repeated rows are turns of their own; null roles and texts are empty; other columns play no part; an empty table gives an
empty result. conv_id % 5 has the sign of conv_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.llm.common import materialize, salted_join, table

#: The prime and the base of the products.
PRIME, BASE = (1 << 127) - 1, 0x1F3D5B79_2468ACE0_13579BDF_0A1B2C3D
#: Conversations share heads of h < HEADS turns with the first of FAMILY conversations.
HEADS, FAMILY = 9, 5
#: Nodes of a chain in one block, ids in one piece of a digest's input.
BLOCK, PIECE = 4096, 65536
EMPTY = bytes(16)


def number(x: bytes | None) -> int:
    return int.from_bytes(x or b"", "big")


def mapped(df: DataFrame, schema: str, row: Callable[..., tuple]) -> DataFrame:
    """df with further columns that row makes of the values of a row, given by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(schema)
    types, names = [f.type for f in to_arrow_schema(made)], [*df.columns, *made.names]
    wanted = row.__code__.co_varnames[: row.__code__.co_argcount]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(*x) for x in zip(*(batch.column(c).to_pylist() for c in wanted))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *made.fields]))


def element(seed: int) -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("t")


def products(conversations: DataFrame, seed: int) -> DataFrame:
    """c, part, i, t, bytes, product: every turn of c, its place from 1, and the product up to it. Turns are sorted by range; a
    conversation that lies in several parts has a product in each, and those of the parts before are put in front."""
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", element(seed), size)
    turns = turns.repartitionByRange(n, "c", "turn", "t").sortWithinPartitions("c", "turn", "t").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, c, i, a = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            places, out = [], []
            for conv, t in zip(batch.column("c").to_pylist(), batch.column("t").to_pylist()):
                if conv != c:
                    c, i, a = conv, 0, 0
                i, a = i + 1, (a * BASE + number(t)) % PRIME
                places.append(i)
                out.append(a.to_bytes(16, "big"))
            kept = [batch.column(x) for x in ("c", "t", "bytes")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([part] * len(out), pa.int32()), pa.array(places, pa.int64()), pa.array(out, pa.binary())], ["c", "t", "bytes", "part", "i", "product"])

    rows = materialize(turns.mapInArrow(run, "c long, t binary, bytes long, part int, i long, product binary"), "turns")
    pieces = rows.groupBy("c", "part").agg(F.max("i").alias("k"), F.max_by("product", "i").alias("a"))
    several = pieces.groupBy("c").agg(F.count("*").alias("pieces"), F.array_sort(F.collect_list(F.struct("part", "k", "a"))).alias("all")).filter("pieces > 1")

    def carried(all: list) -> tuple:  # noqa: A002  at most one piece a part
        k, a, out = 0, 0, []
        for piece in all:
            out.append({"part": piece["part"], "before": k, "carry": a.to_bytes(16, "big")})
            k, a = k + piece["k"], (a * pow(BASE, piece["k"], PRIME) + number(piece["a"])) % PRIME
        return (out,)

    carry = mapped(several, "found array<struct<part:int,before:bigint,carry:binary>>", carried).select("c", F.inline("found"))
    rows = rows.join(F.broadcast(carry), ["c", "part"], "left")  # at most two rows a part, and a part is a partition

    def whole(i: int, product: bytes, before: int | None, carry: bytes | None) -> tuple:
        return ((number(carry) * pow(BASE, i, PRIME) + number(product)) % PRIME).to_bytes(16, "big") if before else product, i + (before or 0)

    rows = mapped(rows, "whole binary, place bigint", whole)
    return materialize(rows.select("c", "part", F.col("place").alias("i"), "t", "bytes", F.col("whole").alias("product")), "products")


def rebuilt(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rebuilt conversations: every prefix but the empty one (c, part, d, product, t, bytes, and the stored turn at), and
    their lengths (c, length)."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).alias("h")
    convs = stored.groupBy("c").agg(F.max("i").alias("own"), F.max_by("product", F.when(F.col("i") == F.crc32(F.col("c").cast("string").cast("binary")) % HEADS, F.col("i"))).alias("own_h"))
    convs = materialize(convs.select("c", (F.col("c") - F.col("c") % FAMILY).alias("base"), "own", "own_h", h), "convs")
    heads = stored.filter(F.col("i") < HEADS).select(F.col("c").alias("base"), "i", "product", "t", "bytes")
    taken = materialize(convs.select("c", "base", "h").join(heads, "base").filter("i <= h"), "heads")
    met = taken.groupBy("c").agg(F.max("i").alias("met"), F.max_by("product", "i").alias("base_h"))
    convs = convs.join(met, "c", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    lengths = convs.select("c", (F.col("met") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    tails = salted_join(stored, convs.select("c", "h", "met", "own_h", "base_h"), ["c"], "part").filter("i > h")

    def prefix(product: bytes, i: int, h: int, own_h: bytes | None, base_h: bytes | None) -> tuple:
        if own_h == base_h:
            return (product,)
        return ((number(product) + (number(base_h) - number(own_h)) * pow(BASE, i - h, PRIME)) % PRIME).to_bytes(16, "big"),

    tails = mapped(tails, "prefix binary", prefix)
    tails = tails.select("c", "part", (F.col("met") + F.col("i") - F.col("h")).alias("d"), F.col("prefix").alias("product"), "t", "bytes", F.struct("c", "i").alias("at"))
    heads = taken.select("c", F.lit(-1).alias("part"), F.col("i").alias("d"), "product", "t", "bytes", F.struct(F.col("base").alias("c"), "i").alias("at"))
    return tails.unionByName(heads), lengths


def verified(conversations: DataFrame, nodes: DataFrame, seed: int) -> bool:
    if nodes.filter("t <> other_t").head(1):
        return False
    asked = nodes.filter("at <> other_at").select("t").distinct()
    turns = conversations.select(element(seed), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).join(asked, "t", "left_semi")
    return not turns.groupBy("t").agg(F.min("role").alias("a"), F.max("role").alias("b"), F.min("text").alias("x"), F.max("text").alias("y")).filter("a <> b or x <> y").head(1)


def digests(ends: DataFrame) -> DataFrame:
    """d, product, ends_sha256: of the ids (c), in order and joined by commas, of every (d, product)."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.repartitionByRange(n, "d", "product", "c").sortWithinPartitions("d", "product", "c")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PIECE):
                d, p, c = (x.to_pylist() for x in batch.slice(begin, PIECE).select(["d", "product", "c"]).columns)
                cuts = [0, *(i for i in range(1, len(c)) if (d[i], p[i]) != (d[i - 1], p[i - 1])), len(c)]
                out = [(d[a], p[a], c[a], ",".join(map(str, c[a:b]))) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.string()))], ["d", "product", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        row = lambda: pa.RecordBatch.from_pydict({"d": [node[0]], "product": [node[1]], "ends_sha256": [digest.hexdigest()]})
        for batch in batches:
            for d, p, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "product", "ids"))):
                if (d, p) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    yield row()
                node, digest = (d, p), hashlib.sha256(ids.encode())
        if node:
            yield row()

    joined = rows.mapInArrow(pieces, "d long, product binary, first long, ids string")
    joined = joined.repartition(n, "d", "product").sortWithinPartitions("d", "product", "first")
    return joined.mapInArrow(hashed, "d long, product binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node."""
    key, seed = ["d", "product"], 0
    while True:
        prefixes, lengths = rebuilt(products(conversations, seed))
        prefixes, lengths = materialize(prefixes, "prefixes"), materialize(lengths, "lengths")
        found = prefixes.groupBy(*key).agg(
            F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
            F.min("t").alias("t"), F.max("t").alias("other_t"), F.min("at").alias("at"), F.max("at").alias("other_at"),
        )
        back = pow(BASE, -1, PRIME)

        def parent(product: bytes, t: bytes) -> tuple:
            return (((number(product) - number(t)) * back % PRIME).to_bytes(16, "big"),)

        nodes = materialize(mapped(found, "parent binary", parent), "nodes")
        if verified(conversations, nodes, seed):
            break
        seed += 1
    nodes = nodes.select(*key, "conv_id", "n_convs", "parent", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    children = nodes.select((F.col("d") - 1).alias("d"), F.col("parent").alias("product")).filter("d > 0").groupBy(*key).agg(F.count("*").alias("n_children"))
    # what the node's chain saves above it: in blocks of the chain, then over the blocks
    nodes = nodes.withColumn("block", F.expr(f"d div {BLOCK}")).join(children, key, "left")
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("all"), F.max(F.col("n_children").isNull().cast("int")).alias("leaf"))
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.withColumn("before", F.coalesce(F.sum("all").over(order), F.lit(0))), "chains")
    inside = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("inside", F.coalesce(F.sum("saved").over(inside), F.lit(0))).join(blocks.select("conv_id", "block", "before"), ["conv_id", "block"])
    chains = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.sum("all").alias("chain"), F.max("leaf").alias("leaf"))
    under = salted_join(prefixes.select("c", "part", *key), chains, ["c"], "part").groupBy(*key).agg(F.sum("chain").alias("chains"), F.sum("leaf").alias("n_leaves"))
    ends = prefixes.select("c", *key).join(lengths.withColumnRenamed("length", "d"), ["c", "d"])
    rows = nodes.join(under, key).join(digests(ends), key, "left")
    rows = rows.withColumn("saved_tokens", F.col("chains") - F.col("before") - F.col("inside"))
    names = nodes.select((F.col("d") + 1).alias("d"), F.col("product").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    first = lengths.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"))
    below = salted_join(rows.filter("d > 1"), names, ["d", "parent"], "product")
    below = below.unionByName(rows.filter("d = 1").crossJoin(F.broadcast(first.select(F.col("conv_id").alias("parent_conv_id")))))  # one row
    no_ends = F.lit(hashlib.sha256().hexdigest())
    below = below.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", no_ends).alias("ends_sha256"))
    # the root: aggregates of one row each
    total = blocks.agg(F.sum("all").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")).crossJoin(nodes.agg(F.count(F.when(F.col("d") == 1, 1)).alias("n_children")))
    at_root = digests(lengths.filter("length = 0").select("c", F.lit(0).cast("long").alias("d"), F.lit(EMPTY).alias("product"))).agg(F.max("ends_sha256").alias("ends_sha256"))
    root = first.filter("n_convs > 0").crossJoin(total).crossJoin(at_root)
    root = root.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", no_ends).alias("ends_sha256"),
    )
    return root.unionByName(below)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trie(table(spark, sf_dir, "conversations"))
    return rows.select(*(F.col(c).cast("long").alias(c) if c != "ends_sha256" else F.col(c) for c in rows.columns))


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text expression."""
    bits = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    byte = "[CAST(('0x' || substr(hex(encode({0})), 2 * p + 1, 2)) AS BIGINT) FOR p IN range(octet_length(encode({0})))]".format(text)
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda crc, byte: {bits}), 4294967295)"


def op12_sql() -> str:
    return f"""WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(said ORDER BY i) AS said, {crc32_sql("CAST(c AS VARCHAR)")} % 9 AS h FROM turns GROUP BY c),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.said[1:a.h], []), a.said[a.h + 1:]) AS said FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, unnest(range(len(said) + 1)) AS d, said FROM rebuilt),
cut AS (SELECT c, d, said[1:d] AS p, len(said) = d AS ends FROM prefixes),
nodes AS (SELECT d, p, min(c) AS c, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(p[d].text)) END AS saved,
sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends FROM cut GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.p = nodes.p),
subtrees AS (SELECT u.d, u.p, sum(v.saved) AS saved, count(*) FILTER (v.k = 0) AS leaves FROM known u JOIN known v ON v.d >= u.d AND v.p[1:u.d] = u.p GROUP BY u.d, u.p)
SELECT known.c AS conv_id, known.d AS depth, up.c AS parent_conv_id, known.n AS n_convs, known.k AS n_children, leaves AS n_leaves, CAST(subtrees.saved AS BIGINT) AS saved_tokens, known.ends AS ends_sha256
FROM known JOIN subtrees ON subtrees.d = known.d AND subtrees.p = known.p LEFT JOIN nodes up ON up.d = known.d - 1 AND up.p = known.p[1:known.d - 1]"""
