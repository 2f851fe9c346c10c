"""Order numbers, batches and windows as columns.

A group is a set of id columns next to each row: items are put into arrays
only when asked for.  Whatever runs along the whole order (numbers, running
maxima, the keys in use) is worked out in range partitions, with a prefix over
what each of them leaves behind; grids are arithmetic; sessions and item caps
look at sums by group first, so that rows are only sorted where a cap is hit.
Batches with limits of bytes or age depend on every batch before; they run
over narrow columns, in order, in one task.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StageError
from ..functions.shared import settled
from ..policies import BatchPolicy, WindowSpec, micros
from .batching import Limits, batch_starts
from .emission import MARK, arranged, named_keys, place

_IN_PART = (1 << 33) - 1
#: Microseconds of the last instant that timestamps hold, and a span longer than any.
_LAST_INSTANT, _EVER = 253_402_300_799_999_999, 1 << 62


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in range partitions by ``order`` with ``_part``, and ``_place`` in it; settled, as the ranges are sampled."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return settled(rows.withColumn("_part", F.shiftright(number, 33).cast("int")).withColumn("_place", number.bitwiseAND(F.lit(_IN_PART))))


def _before(parts: DataFrame, name: str, value: Column, zero) -> DataFrame:
    """Per range partition (a row each) the value over all earlier ones."""
    past = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.withColumn(name, F.coalesce(value.over(past), zero)).select("_p", name))  # one row for each partition


def _upto(*by: str):
    return Window.partitionBy("_part", *by).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """``df`` with ``name``: the place of each row, from 0, along ``order``."""
    rows = _ranged(df, order)
    parts = rows.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    base = _before(parts, "_base", F.sum("_n"), F.lit(0).cast("long"))
    return rows.join(base, F.col("_part") == F.col("_p")).withColumn(name, F.col("_base") + F.col("_place")).drop("_part", "_place", "_p", "_base")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to and with each row along ``order``."""
    rows = _ranged(df, order)
    parts = rows.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_s"))
    base = _before(parts, "_base", F.sum("_s"), F.lit(0))
    return rows.join(base, F.col("_part") == F.col("_p")).withColumn(name, F.col("_base") + F.sum(value).over(_upto())).drop("_part", "_place", "_p", "_base")


def _instant(first, df: DataFrame, clock: str) -> Column:
    """The first known instant, for rows before it; where none is known, the epoch."""
    return F.coalesce(F.lit(first), F.timestamp_micros(F.lit(0))).cast(df.schema[clock].dataType)


def clamped(df: DataFrame, order: list[str], clock: str, name: str = "at") -> DataFrame:
    """``df`` with ``name``: the running maximum of ``clock`` along ``order``; time never runs back, and stands still at nulls."""
    rows = _ranged(df, order)
    parts = rows.groupBy(F.col("_part").alias("_p")).agg(F.max(clock).alias("_m"))
    base = _before(parts, "_base", F.max("_m"), F.lit(None))
    first = rows.agg(F.min_by(clock, F.when(F.col(clock).isNotNull(), F.struct("_part", "_place")))).first()[0]  # for nulls before any instant
    return rows.join(base, F.col("_part") == F.col("_p")).withColumn(name, F.coalesce(F.greatest(F.max(clock).over(_upto()), "_base"), _instant(first, df, clock))).drop("_part", "_place", "_p", "_base")


def steady(df: DataFrame, order: list[str], clock: str) -> bool:
    """Whether ``clock`` is never null and never runs back along ``order``; reads those columns only."""
    if order[0] == clock:
        return df.filter(F.col(clock).isNull()).isEmpty()
    rows = _ranged(df.select(*order, F.col(clock).alias("_c")), order)
    back = F.col("_c") < F.lag("_c").over(Window.partitionBy("_part").orderBy("_place"))
    rows = rows.withColumn("_back", F.coalesce(back, F.lit(False)) | F.col("_c").isNull())
    parts = rows.groupBy("_part").agg(F.max("_back").alias("back"), F.min("_c").alias("lo"), F.max("_c").alias("hi"))
    seen = sorted(parts.collect(), key=lambda r: r["_part"])  # a row for each range
    return not any(r["back"] for r in seen) and all(a["hi"] <= b["lo"] for a, b in zip(seen, seen[1:]))


def with_batch_id(df: DataFrame, order: list[str], policy: BatchPolicy, size: Column | None = None, clock: str | None = None, start: int | None = None) -> DataFrame:
    """``df`` with the batch's number (``BATCH``), from 0; ``start`` is the instant (microseconds) before the first row, if one is known.

    Items alone: arithmetic on the row number.  Else each range of rows finds
    where batches begin, see :mod:`flowspark.operators.batching`.  A null clock
    is the instant before it; a null size is 0.
    """
    shield = _Shield(df)
    order, given = shield.to(*order), df
    clock = None if clock is None else shield.to(clock)[0]
    if policy.bytes_limit is None and policy.age_limit is None:
        rows = numbered(shield.df, order, "_no")
        return shield.back(rows.withColumn(BATCH, F.floor(F.col("_no") / policy.items_limit).cast("long")).drop("_no"))
    age = None if policy.age_limit is None else min(micros(policy.age_limit), _EVER)
    us = F.unix_micros(F.col(clock).cast("timestamp")) if age is not None else F.lit(None)
    sized = given.withColumn("__size", F.greatest(F.coalesce(size if size is not None else F.lit(0), F.lit(0)).cast("long"), F.lit(0))).withColumnsRenamed(shield.names)
    rows = _ranged(sized.withColumnRenamed("__size", "_size").withColumn("_us", us.cast("long")), order)
    starts = settled(batch_starts(rows, Limits(policy.items_limit, policy.bytes_limit, age), start=start))
    parts = starts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_p", "_q")
    every = rows.select(F.col("_part").alias("_p")).distinct().join(parts, F.col("_p") == F.col("_q"), "left").drop("_q")
    base = _before(every, "_base", F.sum("_n"), F.lit(0).cast("long")).withColumnRenamed("_p", "_q")
    flagged = rows.join(starts, (F.col("_part") == F.col("_p")) & (F.col("_place") == F.col("_i")), "left")
    counted = flagged.join(base, F.col("_part") == F.col("_q"))
    return shield.back(counted.withColumn(BATCH, (F.col("_base") + F.count("_i").over(_upto()) - 1).cast("long")).drop("_part", "_place", "_size", "_us", "_p", "_i", "_q", "_base"))


def _most_recent(lists: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Per ``_part`` the ``most`` keys that were last seen, with ``_seen`` (range, place) and their rank."""
    one = lists.groupBy("_part", *keys).agg(F.max("_seen").alias("_seen"))
    return one.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("_seen")))).filter(F.col("_rank") <= most)


def _lru_chunks(df: DataFrame, order: list[str], keys: list[str], most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``name`` counts up each time a key comes back after it was the least recent of more than ``most`` keys; and where each (key, ``lru``) was put out.

    Each range partition replays its own rows, beginning with the ``most`` keys
    last seen before it.  Those come from a scan over the ranges' own lists, in
    steps that double, as long as lists are not full.
    """
    rows = _ranged(df, order)
    n = (rows.agg(F.max("_part")).first()[0] or 0) + 1
    own = rows.select("_part", *keys, F.struct(F.col("_part").alias("p"), F.col("_place").alias("i")).alias("_seen"))
    recent, step = settled(_most_recent(own, keys, most)), 1
    while step < n:
        held = {r["_part"]: r["n"] for r in recent.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
        if all(held.get(p, 0) >= most for p in range(step, n)):
            break
        earlier = recent.withColumn("_part", F.col("_part") + step).filter(F.col("_part") < n)
        recent, step = settled(_most_recent(recent.unionByName(earlier), keys, most)), 2 * step
    before = recent.select((F.col("_part") + 1).alias("_part"), (-F.col("_rank")).cast("long").alias("_place"), *keys).filter(F.col("_part") < n)
    rest = [c for c in df.columns if c not in keys]
    both = before.unionByName(rows.select("_part", "_place", *keys, *rest), allowMissingColumns=True)
    both = both.select("_part", "_place", *keys, *rest).repartition(n, "_part").sortWithinPartitions("_part", "_place")

    def replay(batches):
        used: OrderedDict = OrderedDict()
        now = None
        for b in batches:
            parts, places = b.column(0).to_pylist(), b.column(1).to_pylist()
            news, outs = [], []
            for p, i, k in zip(parts, places, zip(*(c.to_pylist() for c in b.columns[2 : 2 + len(keys)]))):
                if p != now:
                    now, used = p, OrderedDict()
                new, gone = k not in used, None
                if not new:
                    used.move_to_end(k)
                else:
                    if len(used) >= most:
                        gone = used.popitem(last=False)[0]
                    used[k] = None
                if i >= 0:
                    news.append(int(new))
                    outs.append(None if gone is None else {f"k{j}": x for j, x in enumerate(gone)})
            struct = pa.struct([(f"k{j}", c.type) for j, c in enumerate(b.columns[2 : 2 + len(keys)])])
            own = b.filter(pc.greater_equal(b.column(1), 0)) if len(news) < b.num_rows else b
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(news, pa.int32()), pa.array(outs, struct)], [*own.schema.names, "_new", "_gone"])

    fields = T.StructType([T.StructField(f"k{j}", df.schema[k].dataType) for j, k in enumerate(keys)])
    kinds = {f.name: T.StructField(f.name, f.dataType) for f in rows.schema.fields}
    full = T.StructType([*(kinds[c] for c in ["_part", "_place", *keys, *rest]), T.StructField("_new", T.IntegerType()), T.StructField("_gone", fields)])
    rows = settled(both.mapInArrow(replay, full))
    gone = rows.filter("_gone is not null").select(F.col("_gone").alias("key"), place(order).alias("pos"))
    gone = gone.withColumn("lru", (F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1).cast("long"))  # a key's n-th time out ends its n-th time in
    rows = rows.drop("_gone")
    sums = rows.groupBy(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)]).agg(F.sum("_new").alias("_s"))
    past = Window.partitionBy(*[f"_k{j}" for j in range(len(keys))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(past), F.lit(0))).drop("_s")
    on = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)]]
    counted = rows.join(sums, on).withColumn(name, (F.col("_base") + F.sum("_new").over(_upto(*keys)) - 1).cast("long"))
    return counted.drop("_part", "_place", "_p", "_base", "_new", *[f"_k{j}" for j in range(len(keys))]), gone


#: Columns that name a group.  Next to the user's columns they have two lines in front.
GROUP = ("at", "lru", "session", "chunk", "window_start", "window_end")
BATCH = "__batch"


def inner(name: str) -> str:
    return f"__{name}"


def outer(by: list[str]) -> dict[str, str]:
    """What the columns of a group are called once it is aggregated."""
    return {inner(c): c for c in GROUP if inner(c) in by} | ({BATCH: "batch_id"} if BATCH in by else {})


class _Shield:
    """The user's columns under other names, for code that has columns of its own; ``back`` gives theirs back."""

    def __init__(self, df: DataFrame):
        self.names = {c: f"__u{k}" for k, c in enumerate(df.columns) if c.startswith("_") or c in GROUP or c == "batch_id"}
        self.df = df.withColumnsRenamed(self.names)

    def to(self, *columns: str) -> list[str]:
        return [self.names.get(c, c) for c in columns]

    def back(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({u: c for c, u in self.names.items()})


@dataclass(frozen=True)
class Windowed:
    """A row for each item and window; ``by`` names the group, ``bounds`` what only a whole group tells (starts and ends of sessions)."""

    rows: DataFrame
    by: list[str]
    bounds: dict[str, Column] = field(default_factory=dict)
    split: bool = False  # some groups were cut at the cap on items
    evicted: DataFrame | None = None  # where keys were put out
    spec: WindowSpec | None = None
    order: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)

    def marks(self) -> dict[str, Column]:
        """Aggregates of a group from which :meth:`marked` makes what tells when it comes out."""
        due = F.max(F.unix_micros(F.col(inner("at")).cast("timestamp"))) if self.spec.policy.kind == "session" else F.lit(None).cast("long")
        return {"__first": F.min(place(self.order)), "__final": F.max(place(self.order)), "__items": F.count(F.lit(1)), "__due": due}

    def marked(self, out: DataFrame) -> DataFrame:
        """After aggregation, before :meth:`finished`: ``emission.MARK`` instead of the marks."""
        policy = self.spec.policy
        if policy.kind == "session":
            due = F.col("__due") + min(micros(policy.size), _EVER) + 1
        else:
            due = F.unix_micros(F.col(inner("window_start")).cast("timestamp")) + min(micros(policy.size), _EVER)
        ticket = F.min("__first").over(Window.partitionBy(*[c for c in self.by if c != inner("chunk")])) if self.split else F.col("__first")
        mark = F.struct(due.alias("due"), F.col("__final").alias("final"), F.col("__items").alias("n"), ticket.alias("ticket"), F.col(inner("chunk")).alias("chunk"), F.col(inner("lru")).alias("lru"), named_keys(self.keys).alias("key"))
        return out.withColumn(MARK, mark).drop("__first", "__final", "__items", "__due")

    def arranged(self, out: DataFrame) -> DataFrame:
        return arranged(out, self.rows, self.order, inner("at"), self.spec.items_limit, self.evicted)

    def finished(self, out: DataFrame) -> DataFrame:
        """After aggregation: group columns under their own names; a part of a session begins when the part before it was full."""
        out = out.withColumnsRenamed(outer(self.by))
        if not (self.split and "window_start" in self.bounds):
            return out
        names = outer(self.by)
        past = Window.partitionBy(*[names.get(c, c) for c in self.by if c != inner("chunk")]).orderBy("chunk")
        return out.withColumn("window_start", F.coalesce(F.lag("window_end").over(past), "window_start"))


def with_windows(df: DataFrame, order: list[str], clock: str, spec: WindowSpec, keys: list[str] = (), monotone: bool = False, anchor: int | None = None) -> Windowed:
    """Windows of ``df``, by the columns ``at``, ``lru``, ``session``, ``chunk``, and for grids ``window_start`` and ``window_end`` (as :func:`inner` calls them).

    ``monotone``: the clock is known never to run back, so it is not looked at.
    ``anchor``: microseconds of the instant that grids start at, if that is not
    the first row's.  A null clock is the instant before it, and before the
    first known one that one.
    """
    shield = _Shield(df)
    got = _with_windows(shield.df, shield.to(*order), *shield.to(clock), spec, shield.to(*keys), monotone, anchor)
    rows = shield.back(got.rows.withColumnsRenamed({c: inner(c) for c in GROUP if c in got.rows.columns}))
    users = {u: c for c, u in shield.names.items()}
    by = [inner(c) if c in GROUP else users.get(c, c) for c in got.by]
    bounds = {"window_start": F.min(inner("at")), "window_end": F.max(inner("at"))} if spec.policy.kind == "session" else {}
    return Windowed(rows, by, bounds, got.split, got.evicted, spec, list(order), list(keys))


def _with_windows(df: DataFrame, order: list[str], clock: str, spec: WindowSpec, keys: list[str], monotone: bool, anchor: int | None) -> Windowed:
    """Windows of ``df``: columns ``at``, ``lru``, ``session``, ``chunk``, and for grids ``window_start`` and ``window_end``.
    """
    policy = spec.policy
    rows = df.withColumn("at", F.col(clock)) if monotone or steady(df, order, clock) else clamped(df, order, clock)
    evicts = bool(keys) and spec.keys_limit is not None and _may_evict(df, keys, spec.keys_limit)
    rows, evicted = _lru_chunks(rows, order, keys, spec.keys_limit, "lru") if evicts else (rows.withColumn("lru", F.lit(0).cast("long")), None)
    us = F.unix_micros(F.col("at").cast("timestamp"))
    kind = df.schema[clock].dataType

    def instant(col: Column) -> Column:
        return F.timestamp_micros(col).cast(kind)

    if policy.kind == "session":
        rows = _sessions(rows, [*keys, "lru"] if keys else [], us, min(micros(policy.size), _EVER))
        by = [*keys, "lru", "session"]
    else:
        if anchor is None:
            anchor = df.agg(F.min_by(F.unix_micros(F.col(clock).cast("timestamp")), F.when(F.col(clock).isNotNull(), F.struct(*order)))).first()[0] or 0
        by, step, size = [*keys, "lru", "session", "window_start", "window_end"], micros(policy.step or policy.size), micros(policy.size)
        rows = rows.withColumn("session", F.lit(0).cast("long"))
        if anchor + size > _LAST_INSTANT and policy.kind == "tumbling":  # never closes by time: one window, up to the last instant
            end = rows.agg(F.max(us)).first()[0] or anchor
            rows = rows.withColumns({"window_start": instant(F.lit(anchor)), "window_end": instant(F.lit(end))})
        else:
            past = us - F.lit(anchor)
            last = ((past - F.pmod(past, F.lit(step))) / step).cast("long")
            rows = rows.withColumn("_k", F.explode(F.sequence(last - (size - 1) // step, last)) if step < size else last)
            rows = rows.withColumn("_start", F.lit(anchor) + F.col("_k") * step).filter(us - F.col("_start") < size)
            rows = rows.withColumns({"window_start": instant(F.col("_start")), "window_end": instant(F.col("_start") + size)}).drop("_k", "_start")
    rows, split = _capped(rows, by, order, spec.items_limit, df, keys)
    if split and evicts and policy.kind == "sliding":
        raise StageError("window", "sliding windows where both caps, on items and on keys, are hit")
    return Windowed(rows, [*by, "chunk"], split=split, evicted=evicted)


def _capped(rows: DataFrame, by: list[str], order: list[str], most: int | None, items: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """``rows`` with ``chunk``; only groups of more than ``most`` rows are numbered, in range partitions."""
    whole = rows.withColumn("chunk", F.lit(0).cast("long"))
    if most is None or items.count() <= most:  # no item is in a group twice
        return whole, False
    if keys and items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] <= most:  # nor is a group of two keys
        return whole, False
    named = [f"_g{k}" for k in range(len(by))]
    large = rows.groupBy(*[F.col(c).alias(g) for c, g in zip(by, named)]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).drop("_n")
    large = settled(large)
    if large.isEmpty():
        return whole, False
    on = [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, named)]
    here = _ranged(rows.join(large, on, "left_semi"), [*by, *order])
    counts = here.groupBy(F.col("_part").alias("_p"), *[F.col(c).alias(g) for c, g in zip(by, named)]).agg(F.count(F.lit(1)).alias("_n"))
    past = Window.partitionBy(*named).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(past), F.lit(0))).drop("_n")
    here = here.join(counts, [F.col("_part") == F.col("_p"), *on])
    here = here.withColumn("chunk", F.floor((F.col("_base") + F.count(F.lit(1)).over(_upto(*by)) - 1) / most).cast("long")).drop("_part", "_place", "_p", "_base", *named)
    return whole.join(large, on, "left_anti").unionByName(here), True


def _sessions(rows: DataFrame, by: list[str], us: Column, idle: int) -> DataFrame:
    """``rows`` with ``session``.

    Instants less than ``idle`` apart are of one session, so each stretch of
    that length is; the table of stretches, summed before it is sorted, tells
    where sessions begin.
    """
    rows = rows.withColumn("_us", us)
    rows = rows.withColumn("_k", ((F.col("_us") - F.pmod("_us", F.lit(idle))) / idle).cast("long"))
    named = [f"_t{k}" for k in range(len(by))]
    spans = rows.groupBy(*[F.col(c).alias(t) for c, t in zip(by, named)], F.col("_k").alias("_tk")).agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    if by:
        past = Window.partitionBy(*named).orderBy("_tk")
        spans = spans.withColumn("_new", F.when(F.col("_lo") - F.lag("_hi").over(past) > idle, 1).otherwise(0))
        spans = spans.withColumn("session", F.sum("_new").over(past.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    else:
        spans = _ranged(spans, ["_tk"])
        ends = spans.groupBy(F.col("_part").alias("_p")).agg(F.max("_hi").alias("_m"))
        spans = spans.join(_before(ends, "_last", F.max("_m"), F.lit(None)), F.col("_part") == F.col("_p")).drop("_p")
        past = F.lag("_hi").over(Window.partitionBy("_part").orderBy("_place"))
        spans = settled(spans.withColumn("_new", F.when(F.col("_lo") - F.coalesce(past, "_last") > idle, 1).otherwise(0)))
        news = spans.groupBy(F.col("_part").alias("_p")).agg(F.sum("_new").alias("_n"))
        spans = spans.join(_before(news, "_base", F.sum("_n"), F.lit(0).cast("long")), F.col("_part") == F.col("_p"))
        spans = spans.withColumn("session", (F.col("_base") + F.sum("_new").over(_upto())).cast("long"))
    on = [*[F.col(c).eqNullSafe(F.col(t)) for c, t in zip(by, named)], F.col("_k").eqNullSafe(F.col("_tk"))]
    rows = rows.join(spans.select(*named, "_tk", "session"), on).drop("_us", "_k", "_tk", *named)
    return rows if "lru" in rows.columns else rows.withColumn("lru", F.lit(0).cast("long"))


def _may_evict(rows: DataFrame, keys: list[str], most: int) -> bool:
    """Whether there are more keys than the cap; below it nothing is ever evicted."""
    return rows.select(*keys).distinct().count() > most


def group_columns(keys: list[str]) -> list[str]:
    return [*keys, *[inner(c) for c in ("lru", "session", "window_start", "window_end", "chunk")]]


def packed(order: list[str], columns: list[str]) -> Column:
    """All items of a group as an array in order."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.struct(*columns).alias("item"))))
    return F.transform(rows, lambda x: x["item"])
