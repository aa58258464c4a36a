"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots (thousands), bytes are summed per slot, and a versioned
slot-to-shard map says where each slot lives. Rebalancing edits the map: it moves whole slots and leaves the rest alone, so
records never rehash. The map has one row per virtual slot, so its size is fixed by a parameter, whatever the corpus.

Defined cases: a null text has no bytes and the checksum of the empty string; a null doc_id hashes by its text alone; rows that
are equal in every used column are counted before any shuffle, their copies go to consecutive slots, and they are unfolded after
numbering, so repeated rows can't make a hot slot; an empty table gives an empty result. A single row is never divided: shards are
even as far as the largest rows allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.llm.common import exploded_copies, materialize, new_path, table, utf8_size

VIRTUAL_SLOTS = 4096


def virtual_slots(docs: DataFrame, n_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """vslot, doc_id, size, text_crc32, n: n equal rows. Equal rows meet by partial aggregation; the first copy goes to the slot of
    the row's hash, the next to the slot after it, and so on around."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    base = docs.select("doc_id", (utf8_size(F.col("text")) + 1).alias("size"), crc.alias("text_crc32"))
    equal = base.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    places = F.sequence(F.lit(0).cast("long"), F.least(F.col("copies"), F.lit(n_slots).cast("long")) - 1)
    dealt = equal.select("*", F.explode(places).alias("place"))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32") + F.col("place"), F.lit(n_slots)).cast("int")
    n = F.expr(f"copies div {n_slots}") + F.when(F.col("place") < F.col("copies") % n_slots, 1).otherwise(0)
    return dealt.select(slot.alias("vslot"), "doc_id", "size", "text_crc32", n.alias("n"))


def slot_loads(slotted: DataFrame, n_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """vslot, bytes, rows for every slot, empty ones too."""
    spark = slotted.sparkSession
    sums = slotted.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    every = spark.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").fillna(0, ["bytes", "rows"])


def first_map(spark: SparkSession, shards: int, n_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Version 0: slots dealt round. It depends on nothing but the two counts."""
    slot = F.col("id").cast("int")
    return spark.range(n_slots).select(slot.alias("vslot"), (slot % shards).alias("shard"))


def edited_map(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version. Each shard keeps its largest slots up to an even share of the bytes; the slots beyond it, and those of
    shards that are gone, move one by one to whichever shard then holds the least. One row per slot throughout."""
    placed = current.join(loads, "vslot")
    even = F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards)
    fill = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    stays = (F.col("shard") < shards) & (F.sum("bytes").over(fill) <= even)
    placed = placed.select("vslot", "shard", "bytes", stays.alias("stays"))
    kept = placed.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    start = kept.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("held"))
    movers = placed.filter("not stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("movers"))
    empty = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.element_at("held", k), F.lit(0).cast("long")))

    def put(acc, mover):
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1
        loads = F.transform(acc["loads"], lambda x, k: F.when(k == to, x - mover["less"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array(to.cast("int"))).alias("to"))

    dealt = F.aggregate("movers", F.struct(empty.alias("loads"), F.array().cast("array<int>").alias("to")), put)
    moved = (
        start.join(movers)  # one row each
        .select("movers", dealt["to"].alias("to"))
        .select(F.explode(F.arrays_zip("movers", "to")).alias("m"))
        .select(F.col("m.movers.vslot").alias("vslot"), F.col("m.to").alias("shard"))
    )
    return placed.filter("stays").select("vslot", "shard").unionByName(moved)


class SlotMaps:
    """A folder of map versions, one Parquet directory each. A version is never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, slots: DataFrame) -> DataFrame:
        slots.coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.path}/version={version}")

    def rebalance(self, version: int, loads: DataFrame, shards: int) -> DataFrame:
        """Writes version + 1, edited for the given loads and number of shards."""
        return self.write(version + 1, edited_map(self.read(version), loads, shards))


def shard_documents(docs: DataFrame, shards: int, n_slots: int = VIRTUAL_SLOTS, maps: SlotMaps | None = None, version: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version: one row per input row. The law is bytes:
    shards end within about one virtual slot of each other. maps and version: a map of n_slots slots to go on from, so that only
    the slots that must move do; without them a first map is made."""
    spark = docs.sparkSession
    slotted = materialize(virtual_slots(docs, n_slots), "slotted")
    loads = materialize(slot_loads(slotted, n_slots).coalesce(1), "loads")
    if maps is None:
        maps, version = SlotMaps(spark, new_path(spark, "slot-map")), 0
        maps.write(0, first_map(spark, shards, n_slots))
    placed = maps.rebalance(version, loads, shards)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(loads, "vslot").select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    numbered = slotted.withColumn("from", F.sum("n").over(inside) - F.col("n"))
    rows = exploded_copies(numbered.join(F.broadcast(placed), "vslot"), "n", "copy")  # n_slots rows at most
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("from") + F.col("copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version + 1).alias("map_version"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)
