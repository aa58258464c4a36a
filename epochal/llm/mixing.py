"""Mixing sources to target weights by index permutations.

Each source's words are packed, in a fixed order of its documents, into blocks of fixed length, of which only the last may be
short. A mix is a sequence of slots of one block each, cut into output shards. A source's slots are as many as its target needs:
whole passes over its blocks and a part of one more, whose last slot is cut to the words still missing. Each shard's source counts are
drawn as a multinomial: every slot of a shard draws a source with a chance in proportion to its slots. What the draws give a source
beyond its number of slots, counted over the shards in order, doesn't count, and what they leave of it is spread over all shards. The
r-th slot of a source takes the block at place r of that source's own index permutations, one permutation per pass; blocks are then
joined by index. Permutations are computed per row (swap-or-not shuffles), so there is no sort by random number, and reruns agree.

Defined cases: a text without a word (null, empty or blank) is never taken, and a source of such texts has target 0 (so the targets of a
table without words are all 0); a null source is a source, last in order; rows equal in doc_id, source and size are counted before any
shuffle and unfolded afterwards; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.llm.common import WORD, exploded_copies, materialize, row_hash, table, unused

BLOCK_WORDS = 128
MOST_PASSES = 3
#: An output shard has at least so many slots, and there are at most so many shards.
SLOTS_PER_SHARD, MOST_SHARDS = 8192, 1 << 16
#: Parts of all slots by which the source of a draw is looked up.
CELLS = 4096
#: Parts of a source in which offsets are summed by themselves; bounds no size.
PARTS = 1024
ROUNDS = 24


def permuted(i: Column, n: Column, *keys: Column, inverse: bool = False) -> Column:
    """A swap-or-not shuffle of 0 .. n-1 under the keys: in each round, i may swap with its mirror image about a point that the
    round's key gives, as one hashed bit of the larger of the two says. It is a bijection for any n, and a round undoes itself, so
    the rounds from last to first are its inverse."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *keys), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, mirror), r, *keys) % 2 == 0, mirror).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, i.cast("long"), step)


def counted(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def targets(sizes: DataFrame, seed: int = 0, most: int = MOST_PASSES) -> DataFrame:
    """key, source, source_size, target, blocks, slots, cut, first: a row per source. Sources weigh 1, 2, 3 and so on again in code
    point order, null last. A target is the smaller of most times the source's size and its weight's share of a common level;
    the level follows from one pass over the sources in the order in which they fill up. cut: the words of the last slot, null if
    it is whole; first: the slots of the sources before."""
    one = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    one = one.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", most * F.col("source_size"))
    filling = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total, weights = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    left = total - (F.sum("cap").over(filling) - F.col("cap"))
    level = left / (weights - (F.sum("weight").over(filling) - F.col("weight")))
    one = one.withColumn("level", level).withColumn("nth", F.row_number().over(filling))
    found = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("nth", "level"))).over(Window.partitionBy())["level"]
    one = one.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(found, F.lit(0.0))))
    one = one.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"))
    # whole passes, and the words of one more, of which the short block may be early or late in that pass's permutation
    words = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    one = one.withColumn("key", source_key()).withColumn("passes", F.coalesce(F.floor(words / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))).withColumn("rest", words - F.col("passes") * F.col("source_size"))
    one = one.withColumn("lacks", F.col("blocks") * BLOCK_WORDS - F.col("source_size")).withColumn("full", F.ceil(F.col("rest") / BLOCK_WORDS))
    one = one.withColumn("short_at", block_at(F.col("blocks") - 1, seed, inverse=True))
    held = lambda n: n * BLOCK_WORDS - F.when(F.col("short_at") < n, F.col("lacks")).otherwise(0)
    one = one.withColumn("more", F.col("full") + F.when(held(F.col("full")) < F.col("rest"), 1).otherwise(0))
    one = one.withColumn("slots", F.when(F.col("source_size") > 0, F.col("passes") * F.col("blocks") + F.col("more")).otherwise(F.lit(0)).cast("long"))
    one = one.withColumn("cut", F.when(F.col("rest") > 0, F.col("rest") - held(F.col("more") - 1)))
    first = F.sum("slots").over(order) - F.col("slots")
    return one.select("key", "source", "source_size", "target", "blocks", "slots", "cut", first.alias("first"))


def block_at(place: Column, seed: int, number: Column | None = None, inverse: bool = False) -> Column:
    """The block at a place of a pass (by default the last one) over a source's blocks, or the place of a block."""
    number = F.col("passes") if number is None else number
    return permuted(place, F.greatest("blocks", F.lit(1)), F.lit(seed + 1), F.col("key"), number, inverse=inverse)


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def shard_counts(sources: DataFrame, seed: int = 0) -> DataFrame:
    """key, shard, n, from: how many slots each output shard takes of a source, and how many the shards before it do."""
    spark, total = sources.sparkSession, int(sources.agg(F.sum("slots")).first()[0] or 0)
    per_shard, cell = max(SLOTS_PER_SHARD, -(-total // MOST_SHARDS)), max(1, -(-total // CELLS))
    some = sources.filter("slots > 0").select("key", "slots", "first")
    drawn = spark.range(total).select(F.expr(f"cast(id div {per_shard} as int)").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("x"))
    # a draw's source is the one in whose slots x lies; sources are listed for each cell that they reach into
    listed = some.withColumn("cell", F.explode(F.sequence(F.expr(f"first div {cell}"), F.expr(f"(first + slots - 1) div {cell}"))))
    drawn = drawn.withColumn("cell", F.expr(f"x div {cell}")).join(listed, "cell").filter((F.col("x") >= F.col("first")) & (F.col("x") < F.col("first") + F.col("slots")))
    drawn = drawn.groupBy("key", "shard").agg(F.count("*").alias("drawn"))
    shards = -(-total // per_shard)
    every = some.select("key", "slots", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))).alias("shard"))
    order = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.least(F.sum(F.coalesce("drawn", F.lit(0))).over(order), F.col("slots"))
    every = every.join(drawn.hint("merge"), ["key", "shard"], "left").select("key", "slots", "shard", so_far.alias("so_far"))
    left = F.col("slots") - F.max("so_far").over(Window.partitionBy("key"))
    until = F.col("so_far") + F.floor(left * (F.col("shard") + 1) / shards)
    every = every.select("key", "shard", until.alias("until"))
    begin = F.coalesce(F.lag("until").over(Window.partitionBy("key").orderBy("shard")), F.lit(0))
    return every.select("key", "shard", (F.col("until") - begin).alias("n"), begin.alias("from")).filter("n > 0")


def mix_plan(sources: DataFrame, seed: int = 0) -> DataFrame:
    """shard, key, block, cut: every slot of the mix. A source's slots are unfolded by shard, so a source with a third of all slots
    is made by many tasks."""
    counts = shard_counts(sources, seed).join(sources.select("key", "blocks", "slots", "cut"), "key")
    counts = counts.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "shard")
    slots = exploded_copies(counts, "n", "i").withColumn("r", F.col("from") + F.col("i"))
    block = block_at(F.col("r") % F.col("blocks"), seed, F.expr("r div blocks"))
    return slots.select("shard", "key", block.alias("block"), F.when(F.col("r") == F.col("slots") - 1, F.col("cut")).alias("cut"))


def packed(sizes: DataFrame) -> DataFrame:
    """doc_id, source, key, size, from: where in its source's words each document begins: by part (a hash of the document), then by
    doc_id. Offsets are summed within parts of a source, then over the parts, so no task needs a whole source."""
    part = F.pmod(F.xxhash64("doc_id", "size"), F.lit(PARTS)).cast("int")
    rows = sizes.withColumn("key", source_key()).withColumn("part", part)
    inside = Window.partitionBy("key", "part").orderBy("doc_id", "size")
    rows = rows.withColumn("within", F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n"))
    parts = rows.groupBy("key", "part").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    before = Window.partitionBy("key").orderBy("part")
    parts = parts.select("key", "part", (F.sum("words").over(before) - F.col("words")).alias("before"))
    rows = exploded_copies(rows.join(parts, ["key", "part"]), "n", "copy")
    return rows.select("doc_id", "source", "key", "size", (F.col("before") + F.col("within") + F.col("copy") * F.col("size")).alias("from"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard, source: one row per input row; first_shard is the first output shard
    that takes words of it (null: none does)."""
    sizes = materialize(counted(docs), "sizes")
    sources = materialize(targets(sizes, seed), "sources")
    plan = mix_plan(sources, seed).groupBy("key", "block").agg(F.count(F.when(F.col("cut").isNull(), 1)).alias("times"), F.max("cut").alias("cut"), F.min("shard").alias("shard"))
    rows = packed(sizes)
    last = F.expr(f"(`from` + size - 1) div {BLOCK_WORDS}")
    pieces = rows.filter("size > 0").select("key", "source", "from", "size", "doc_id", F.explode(F.sequence(F.expr(f"`from` div {BLOCK_WORDS}"), last)).alias("block"))
    begin, end = F.greatest("from", F.col("block") * BLOCK_WORDS), F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    # the plan comes of a small table, and the planner would take it for small
    pieces = pieces.withColumn("begin", begin).withColumn("end", end).join(plan.hint("merge"), ["key", "block"], "left")
    once = F.greatest(F.least("end", F.col("block") * BLOCK_WORDS + F.coalesce("cut", F.lit(0))) - F.col("begin"), F.lit(0))
    words = F.coalesce("times", F.lit(0)) * (F.col("end") - F.col("begin")) + once
    document = ["key", "source", "from", "size", "doc_id"]
    taken = pieces.groupBy(*document).agg(F.sum(words).alias("taken"), F.min(F.when(words > 0, F.col("shard"))).alias("first_shard"))
    empty = rows.filter("size = 0").select(*document, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("int").alias("first_shard"))
    return taken.unionByName(empty).join(sources.select("key", "source_size", "target"), "key").select("doc_id", "size", "source_size", "target", "taken", "first_shard", "source")


#: How finely documents are ordered by size, and parts of the documents of like size, in resampled; they bound no size.
SIZE_STEPS, SIZE_PARTS, UNIT = 16, 64, 1 << 30


def resampled(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs as the mix has them: each document as often as the mix takes its words, rounded up or down. The documents of a source are
    ordered by size and the parts that rounding cuts off are summed along that order; where the sum passes a whole number, a document
    is rounded up. So a source's words come within about its largest document of its target. The columns stay. Rows with one
    doc_id and source are one group here: all are taken equally often, and a hash of their content says which of them are rounded up.
    Of rows that are equal in all columns so many are rounded up as their number and the hash ask, and it doesn't matter which; so
    no draw depends on the order of rows."""
    one = mixed(docs, seed).withColumn("key", source_key()).groupBy("doc_id", "source", "key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.count("*").alias("n"))
    one = one.filter("taken > 0").withColumn("times", F.expr("taken div size"))
    over = (F.col("taken") - F.col("times") * F.col("size")) * F.col("n") * F.lit(float(UNIT)) / F.col("size")
    one = one.withColumn("over", F.round(over).cast("long")).withColumn("step", F.floor(F.log2(F.col("size") / F.col("n")) * SIZE_STEPS))
    one = materialize(one.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SIZE_PARTS))), "rounding")
    parts = one.groupBy("key", "step", "part").agg(F.sum("over").alias("all_over"))
    before = Window.partitionBy("key").orderBy("step", "part")
    parts = parts.select("key", "step", "part", (F.sum("all_over").over(before) - F.col("all_over") + F.lit(UNIT // 2)).alias("before"))
    inside = Window.partitionBy("key", "step", "part").orderBy("size", "doc_id")
    begin = F.col("before") + F.sum("over").over(inside) - F.col("over")
    up = F.expr(f"(begin + over) div {UNIT}") - F.expr(f"begin div {UNIT}")
    one = one.join(parts, ["key", "step", "part"]).withColumn("begin", begin).withColumn("up", up)
    i, s, times, n, more, copy, row, like = unused(docs, "id", "source_of", "times", "n", "up", "copy", "row", "like")
    one = one.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("times").alias(times), F.col("n").alias(n), F.col("up").alias(more))
    kept = docs.join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)))
    alone = kept.filter(F.col(n) == 1).select(F.struct(*docs.columns).alias(row), (F.col(times) + F.col(more)).alias(times))
    same = kept.filter(F.col(n) > 1).withColumn(row, F.struct(*docs.columns)).withColumn(like, F.struct(row_hash(docs, 0), row_hash(docs, 1)))
    same = same.groupBy(i, s, times, n, more, like).agg(F.first(row).alias(row), F.count("*").alias(copy))
    chance = F.pmod(F.xxhash64(like, F.lit(seed)), F.lit(UNIT)) / float(UNIT)
    whole = F.col(copy) * F.least(more, n)
    ups = F.expr(f"`{copy}` * least(`{more}`, `{n}`) div `{n}`") + F.when(whole % F.col(n) > chance * F.col(n), 1).otherwise(0)
    same = same.select(row, (F.col(times) * F.col(copy) + ups).alias(times))
    taken = exploded_copies(alone.unionByName(same).filter(F.col(times) > 0), times, copy)
    return taken.select(f"{row}.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
