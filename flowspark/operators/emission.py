"""When windows come out: the order in which their groups reach what follows them.

A group comes out at the first row whose clock has reached its end, before that
row; or when its key is put out to make room for a row's new key; or with the
row that fills it; or at the end of all rows.  Groups that one row brings out
come by their ends, then by their first rows.  The row is found for all groups
at once: instants of rows and ends of groups are dealt into ranges of time,
and each end looks up the next instant in its range or in a later one.

Sessions whose ends fall on one instant, and sliding windows of several keys at
the end of all rows, come in the order of their first rows, which the rows'
own history may order otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import settled

#: What a group carries until its place is asked for.
MARK = "emitted_at"


def place(order: list[str]) -> Column:
    """A row's place in the order, under names that all orders share."""
    return F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])


def named_keys(keys: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(keys)]) if keys else F.lit(0)


def first_after(instants: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each ``t`` of ``wanted`` the ``pos`` of the first row of ``instants`` (``t``, ``pos``; both ascend) that is not before it, as ``due`` and ``out_at``."""
    kind = instants.schema["pos"].dataType
    both = instants.select("t", F.lit(1).alias("kind"), "pos").unionByName(wanted.select("t").distinct().select("t", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("pos")))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(both.repartitionByRange(n, "t", "kind").withColumn("part", F.spark_partition_id()))
    later = Window.orderBy(F.desc("of")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("part").alias("of")).agg(F.min("pos").alias("least"))  # a row for each range
    parts = parts.withColumn("rest", F.min("least").over(later)).select("of", "rest")
    here = F.min("pos").over(Window.partitionBy("part").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("here", here).filter("kind = 0").join(F.broadcast(parts), F.col("part") == F.col("of"))
    return rows.select(F.col("t").alias("due"), F.coalesce("here", "rest").alias("out_at"))


def arranged(groups: DataFrame, rows: DataFrame, order: list[str], clock: str, most: int | None, evicted: DataFrame | None) -> DataFrame:
    """``groups`` with ``MARK`` turned into their place: a struct that sorts as they come out."""
    us = F.unix_micros(F.col(clock).cast("timestamp"))
    instants = rows.groupBy(us.alias("t")).agg(F.min(place(order)).alias("pos"))
    mark = F.col(MARK)
    found = groups.join(first_after(instants, groups.select(mark["due"].alias("t"))), mark["due"] == F.col("due"), "left").drop("due")
    if evicted is not None:
        on = F.col("_out_key").eqNullSafe(mark["key"]) & (F.col("_out_lru") == mark["lru"])
        found = found.join(evicted.select(F.col("key").alias("_out_key"), F.col("lru").alias("_out_lru"), F.col("pos").alias("_out")), on, "left").drop("_out_key", "_out_lru")
    else:
        found = found.withColumn("_out", F.lit(None).cast(instants.schema["pos"].dataType))

    def at(last: int, pos: Column, phase: int, due: Column) -> Column:
        return F.struct(F.lit(last).alias("last"), pos.alias("row"), F.lit(phase).alias("phase"), due.alias("due"), mark["ticket"].alias("ticket"), mark["chunk"].alias("chunk"))

    zero, none = F.lit(0).cast("long"), F.lit(None).cast(instants.schema["pos"].dataType)
    ways = [F.when(F.col("out_at").isNotNull(), at(0, F.col("out_at"), 0, mark["due"])), F.when(F.col("_out").isNotNull(), at(0, F.col("_out"), 1, mark["due"])), at(1, none, 3, zero)]
    if most is not None:
        ways.append(F.when(mark["n"] >= most, at(0, mark["final"], 2, zero)))
    return found.withColumn(MARK, F.least(*ways)).drop("out_at", "_out")
