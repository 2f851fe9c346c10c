"""Mixing sources to target weights by weighted fair queueing.

Each source's documents come in an order shuffled by hash, up to ``repeats``
times over.  A document's virtual finish time is its source's cumulative tokens
divided by the source's target; taking all documents in that order until the
budget is spent serves each source in proportion.  Cumulative sums over hot
sources and over the whole queue are taken in two levels: hash ranges (or time
ranges) are summed first, with partial aggregation, and only rows of one range
are sorted together, so no source is ever in one task.

DataFrame operations only.  Defined results: a null text has size 0 and is
taken 0 times; null sources form one source, the last; repeated rows count each
for itself; ties fall by id and text hash; an empty table gives an empty
result; input columns other than id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running_sum, settle, spread


def targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """Targets per source from ``(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes.  A target is min(repeats * size, weight * level) at the
    one level that spends the sum; sources are few, so one window sorts them.
    """
    # Strings are compared by code point, as UTF-8 bytes.
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spare = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    # The level if exactly the sources before this one are full; this is right for the first that does not fill.
    x = x.withColumn("level", spare / left)
    x = x.withColumn("place", F.row_number().over(fill))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"]
    return x.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0)))).select("source", "source_size", "target")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    rows = settle(rows.withColumn("salt", salt()))  # narrow: the texts are read once
    # Rows that are alike in id, source and text get a number, so that each has a place of its own.
    rows = apart(rows, ["id", "source", "h", "size"])
    rows = settle(rows.withColumn("h", F.xxhash64("h", "source", "twin")).drop("salt", "twin"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, repeats)
    n = spread(rows.count(), 20_000, 16)
    rows = rows.withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(n)).cast("long"))
    cum = running_sum(rows, ["source"], "b", ["h", "id", "size"], "size", "cum")
    goal = settle(goal).withColumnRenamed("source", "_src")
    cum = cum.join(F.broadcast(goal) if _few(goal) else goal, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    queue = cum.filter("size > 0 and target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    queue = queue.withColumn("v", (F.col("cum") + F.col("copy") * F.col("source_size")) / F.col("target"))
    # At time v a source has had v * target words, less one document at most; sources at their cap have none
    # left at time 1.  So the budget is spent by ``latest``, and copies beyond it never fit.
    largest = rows.groupBy(F.col("source").alias("_largest")).agg(F.max("size").alias("most"))
    open_ = goal.filter("target < source_size * %d" % repeats).join(largest, F.col("_src").eqNullSafe(F.col("_largest")))
    latest = open_.agg((1 + F.coalesce(F.sum("most") / F.sum("target"), F.lit(0.0))).alias("latest")).first()[0]
    queue = queue.filter(F.col("v") <= (latest * (1 + 1e-9)))
    queue = settle(queue.select("id", "h", "size", "copy", "v").withColumn("t", F.floor(F.col("v") * n * 4)))
    run = running_sum(queue, [], "t", ["v", "h", "id", "copy"], "size", "upto")
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    got = run.filter(F.col("upto") <= budget).groupBy("id", "h").agg(F.count(F.lit(1)).alias("got"))
    got = got.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "got")
    out = cum.join(got, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left").withColumn("copies", F.coalesce("got", F.lit(0)))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "text_hash")


def _few(goal: DataFrame, most: int = 100_000) -> bool:
    """Whether so few sources exist that their targets may be broadcast."""
    return len(goal.limit(most + 1).select(F.lit(1)).collect()) <= most


def salt(ways: int = 1024) -> Column:
    """A number that spreads rows that are alike; use it on rows that are settled with it."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(ways)).cast("long")


def apart(rows: DataFrame, keys: list[str], first: Column | None = None) -> DataFrame:
    """``rows`` (settled, with ``salt``) with ``twin``: 1 and up among rows with equal ``keys``, in the order of the number ``first``.

    Numbers are taken in two levels, so no key is in one task.
    """
    held = [f"_{k}" for k in keys]
    often = rows.groupBy(*[F.col(k).alias(h) for k, h in zip(keys, held)]).agg(F.count(F.lit(1)).alias("_often")).filter("_often > 1").drop("_often")
    often = settle(often)
    if often.isEmpty():
        return rows.withColumn("twin", F.lit(1).cast("long"))
    on = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, held)]
    bucket = F.col("salt") if first is None else F.pmod(first, F.lit(64)) * 1024 + F.col("salt")
    some = rows.join(often, on, "left_semi").withColumns({"_bucket": bucket, "_one": F.lit(1)})
    some = running_sum(some, keys, "_bucket", ["_bucket"], "_one", "twin").drop("_bucket", "_one")
    return rows.join(often, on, "left_anti").withColumn("twin", F.lit(1).cast("long")).unionByName(some)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_sources` takes it, with all its columns, whatever their names; rows of size 0 go.

    Rows alike in id, text and source share what is taken of them evenly.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*own)
    id_, text, source = (own[docs.columns.index(c)] for c in (id_col, text_col, source_col))
    plan = mix_sources(rows, id_col=id_, text_col=text, source_col=source, **options)
    plan = plan.groupBy(F.col(id_).alias("id"), F.col("text_hash").alias("hash"), F.col(source).alias("of")).agg(F.sum("copies").cast("long").alias("n"), F.count(F.lit(1)).alias("rows"))
    plan = settle(plan.filter("n > 0"))
    both = rows.withColumn("key", F.xxhash64(text)).join(plan, F.col(id_).eqNullSafe(F.col("id")) & (F.col("key") == F.col("hash")) & F.col(source).eqNullSafe(F.col("of")))
    copies = both.filter("rows = 1")
    if not plan.filter("rows > 1").isEmpty():
        shared = settle(both.filter("rows > 1").withColumn("salt", salt()))
        shared = apart(shared, ["id", "hash", "of"], F.xxhash64(*own))
        share = F.floor(F.col("n") / F.col("rows")).cast("long") + (F.col("twin") <= F.col("n") % F.col("rows")).cast("long")
        copies = copies.unionByName(shared.withColumn("n", share).filter("n > 0").select(*copies.columns))
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*own).toDF(*docs.columns)
