"""Numbers and sums along a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.sources.shared import materialize


def running(df: DataFrame, name: str, value: Column, *order: Column | str) -> DataFrame:
    """df with two more columns: name, the sum of value along the order up to each row, and name_total, the sum of all. Rows are dealt
    by ranges of the order and written once; sums run within the ranges, and one row per range says what comes before it."""
    rows = df.withColumn("order_value", value).orderBy(*order).withColumn("order_at", F.monotonically_increasing_id())
    rows = materialize(rows, "ordered").withColumn("order_part", F.shiftright("order_at", 33))
    parts = rows.groupBy("order_part").agg(F.sum("order_value").alias("order_sum"))
    every = Window.partitionBy()  # one row per partition
    before = F.sum("order_sum").over(every.orderBy("order_part")) - F.col("order_sum")
    parts = parts.select("order_part", before.alias("order_before"), F.sum("order_sum").over(every).alias(f"{name}_total"))
    inside = F.sum("order_value").over(Window.partitionBy("order_part").orderBy("order_at"))
    out = rows.withColumn(name, inside).join(parts, "order_part").withColumn(name, F.col(name) + F.col("order_before"))
    return out.drop("order_value", "order_at", "order_part", "order_before")


#: Parts of a numeric order, and the leading characters of a digest that make a part.
CELLS, LEADING = 256, 3


def parted(df: DataFrame, name: str, value: Column, part: Column, order: list[Column | str], group: list[str]) -> DataFrame:
    """As running, within each group, for an order that has all rows of a lower part before those of a higher one. Sums run within
    parts, and one row a part says what comes before it: one shuffle, and nothing is written."""
    rows = df.withColumn("order_part", part).withColumn("order_value", value)
    sums = rows.groupBy(*group, "order_part").agg(F.sum("order_value").alias("order_sum"))
    every = Window.partitionBy(*group)  # one row a part
    before = F.sum("order_sum").over(every.orderBy("order_part")) - F.col("order_sum")
    sums = sums.select(*group, "order_part", before.alias("order_before"), F.sum("order_sum").over(every).alias(f"{name}_total"))
    inside = F.sum("order_value").over(Window.partitionBy(*group, "order_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("order_inside", inside).join(sums if group else F.broadcast(sums), [*group, "order_part"])  # at most 4,096 rows
    return out.withColumn(name, F.col("order_inside") + F.col("order_before")).drop("order_part", "order_value", "order_inside", "order_before")


def numbered_by_digest(df: DataFrame, name: str, digest: Column, *group: str) -> DataFrame:
    """df with the rows' numbers from 1 along a hexadecimal digest within each group, and name_total, their count."""
    rows = df.withColumn("order_digest", digest)
    return parted(rows, name, F.lit(1).cast("long"), F.left("order_digest", F.lit(LEADING)), ["order_digest"], [*group]).drop("order_digest")


def running_by_number(df: DataFrame, name: str, value: Column, key: str) -> DataFrame:
    """As running, along a numeric column: parts are cut at its approximate percentiles, which one small aggregate gives."""
    cuts = df.agg(F.percentile_approx(key, [i / CELLS for i in range(1, CELLS)], 10_000)).first()[0] or []
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(key))), F.lit(-1)) if cuts else F.lit(0)
    return parted(df, name, value, part, [key], [])


def permuted(x: Column, n: Column | int, key: str, rounds: int = 12) -> Column:
    """Where a keyed bijection of 0 .. n-1 takes x: in each round x may swap with its mirror image about a point of the round's, as one
    bit of a digest of the larger of the two says. No row needs another, so any slice of a permutation can be made by itself."""
    n = F.lit(n) if isinstance(n, int) else n

    def step(y: Column, r: Column) -> Column:
        point = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), r.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
        mirror = F.pmod(point - y, n)
        bit = F.md5(F.concat_ws("|", F.lit(key), r.cast("string"), F.greatest(y, mirror).cast("string")).cast("binary"))
        return F.when(F.left(bit, F.lit(1)) < "8", mirror).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def permuted_sql(x: str, n: str, key: str, rounds: int = 12) -> str:
    """The same as SQL."""
    mirror = f"(((CAST('0x' || left(md5(concat_ws('|', '{key}', r)), 12) AS BIGINT) - y) % {n} + {n}) % {n})"
    return f"list_reduce(list_prepend(CAST({x} AS BIGINT), range(1, {rounds + 1})), lambda y, r: CASE WHEN left(md5(concat_ws('|', '{key}', r, greatest(y, {mirror}))), 1) < '8' THEN {mirror} ELSE y END)"


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the rows' numbers from 1 along the order, and name_total, their count."""
    return running(df, name, F.lit(1).cast("long"), *order)
