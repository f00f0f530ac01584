"""Places, running totals and lookups that no hot group can slow down: a group of any size is spread over ranges or blocks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwarden.session import stage_table

HOT_ROWS, HOT_SHARE = 1000, 0.001


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with `pos`, a row's place from 0 among the rows of its group by `order` (nulls first), and `n`, the group's size.

    Rows are cut into ranges of (group, order), counted per range and group, and placed by the counts of the
    ranges before theirs.  Rows that are equal in all of these get different places, in no stated order.
    """
    keys = [*group, *order, "_tie"]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys)
               .sortWithinPartitions(*keys).drop("_tie")
               .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    placed = stage_table(sorted_, "sorted")
    heads = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("_k").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(*group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_k").over(whole).alias("n"))
    joined = placed.alias("l").join(heads.alias("r"), _same("l", "r", [*group, "_part"]))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_at") + F.col("_shift")).alias("pos"), F.col("r.n"))


def running(df: DataFrame, group: str, totals: dict[str, Column], block: int = 4096) -> DataFrame:
    """`df` (group, pos) with each of `totals` (an aggregate that can be applied to its own results, under its name) over the
    group's rows up to and including this one.

    Rows are summed per block of places, blocks per group, and rows inside a block.
    """
    at = F.floor(F.col("pos") / block)
    rows = df.withColumn("_block", at)
    inside = Window.partitionBy(group, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(group, "_block").agg(*[fn(F.col(c)).alias(c) for c, fn in totals.items()])
    blocks = blocks.select(group, "_block", *[fn(F.col(c)).over(earlier).alias(f"_before_{c}") for c, fn in totals.items()])
    rows = rows.select("*", *[fn(F.col(c)).over(inside).alias(f"_inside_{c}") for c, fn in totals.items()])
    return rows.join(blocks, [group, "_block"]).drop("_block")


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of `rows` with `table`, which has one row per key and in `count` the number of `rows` with it, `total` in all.

    Keys with `HOT_SHARE` of the rows or more, of which there are 1 / HOT_SHARE at most, are broadcast; the rest is shuffled.
    """
    values = [c for c in table.columns if c not in (key, count)]
    frequent = F.col(count) >= max(HOT_ROWS, int(total * HOT_SHARE))
    hot = F.broadcast(table.filter(frequent).select(key, *values, F.lit(True).alias("_hot")))
    near = rows.join(hot, key, "left")
    rest = near.filter("_hot is null").select(*rows.columns).join(table.filter(~frequent).select(key, *values), key, "left")
    return near.filter("_hot").select(*rows.columns, *values).unionByName(rest.select(*rows.columns, *values))
