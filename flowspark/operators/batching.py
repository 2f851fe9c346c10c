"""Where batches with limits of bytes or age begin, worked out in all ranges at once.

A batch depends on the one before it, so its first item is only known once all
earlier ones are.  But from any item that may begin a batch, the item that
closes it is found by binary search over running sums and maxima, so each range
of rows links every item to the next beginning on its own.  Pointer doubling
then tells, for every item, the last beginning in its range of a chain from
there.  Batches that a range leaves open look up their end in the range that
holds it; this gives links from range to range, a chain of which, from the first
row, visits each range once at most.  A last pass marks what the chain passes.

Links between ranges are as many as there are items in the batches that may
cross an edge.  Up to ``walk_limit`` of them are followed on the driver; beyond
that, links are doubled by joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import settled

_FAR = np.iinfo(np.int64).max
_END = -(1 << 62)


@dataclass(frozen=True)
class Limits:
    """An item closes a batch if it is the ``items``-th, brings it to ``bytes``, or comes ``age`` microseconds or more after its first item."""

    items: int | None = None
    bytes: int | None = None
    age: int | None = None


class _Ranges:
    """What is known of each range: a row for each, whatever the number of items."""

    def __init__(self, rows: DataFrame, start: int | None):
        known = F.col("_us").isNotNull()
        seen = rows.groupBy("_part").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("_size").cast("decimal(38,0)")).alias("size"),
            F.max("_us").alias("top"),
            F.min_by("_us", F.when(known, F.col("_place"))).alias("first"),
            F.max_by("_us", F.when(known, F.col("_place"))).alias("last"),
        )
        seen = sorted(seen.collect(), key=lambda r: r["_part"])
        self.place = {r["_part"]: k for k, r in enumerate(seen)}
        self.rows = np.cumsum([0, *[r["n"] for r in seen]])
        self.sizes = np.cumsum([0, *[int(r["size"]) for r in seen]])
        before = start if start is not None else next((r["first"] for r in seen if r["first"] is not None), 0)
        carried = []
        for r in seen:  # a null instant is the one before it, at the start the first known one
            carried.append(before)
            before = before if r["last"] is None else r["last"]
        self.carried = np.array(carried, np.int64)
        self.top = np.array([max(c, r["top"] if r["top"] is not None else c) for c, r in zip(carried, seen)], np.int64)

    def __len__(self) -> int:
        return len(self.carried)

    def part(self, k: int) -> int:
        return list(self.place)[k]


class _Range:
    """The rows of one range, in order, and their links."""

    def __init__(self, table: pa.Table, ranges: _Ranges, limits: Limits):
        place = table.column("_place").to_numpy()
        order = np.argsort(place, kind="stable")
        self.k = ranges.place[table.column("_part")[0].as_py()]
        self.place, self.n, self.limits, self.all = place[order], len(place), limits, ranges
        self.upto = np.append(0, np.cumsum(table.column("_size").to_numpy()[order]))
        us = table.column("_us").take(pa.array(order)).combine_chunks()
        known = us.is_valid().to_numpy(zero_copy_only=False)
        from_ = np.maximum.accumulate(np.where(known, np.arange(self.n), -1))
        us = us.fill_null(0).to_numpy()
        self.us = np.where(from_ >= 0, us[np.maximum(from_, 0)], ranges.carried[self.k])
        self.top = np.maximum.accumulate(self.us)

    def links(self) -> np.ndarray:
        """For each item as the first of a batch: the last item of that batch (``n`` if it is not in this range)."""
        i, last = np.arange(self.n), np.full(self.n, self.n)
        if self.limits.items is not None:
            last = np.minimum(last, i + min(self.limits.items, self.n + 1) - 1)
        if self.limits.bytes is not None:
            last = np.minimum(last, np.searchsorted(self.upto, self.upto[:-1] + self.limits.bytes) - 1)
        if self.limits.age is not None:
            due = self.us + self.limits.age
            old = np.searchsorted(self.top, due)
            for k in np.flatnonzero(self.top >= due):  # the clock had run back by more than the age
                late = np.flatnonzero(self.us[k + 1 : last[k]] >= due[k])
                old[k] = k + 1 + late[0] if len(late) else self.n
            last = np.minimum(last, np.maximum(old, i))
        return np.minimum(last, self.n)

    def ends(self, last: np.ndarray) -> np.ndarray:
        """By pointer doubling: from each item, the beginning of the batch that this range leaves open, or ``n`` if it leaves none."""
        to = np.append(np.where(last < self.n, last + 1, np.arange(self.n)), self.n)
        while True:
            further = to[to]
            if (further == to).all():
                return to
            to = further

    def base(self) -> int:
        return int(self.all.rows[self.k])

    def questions(self) -> pa.Table:
        """For each batch that may be left open: the range that holds its end, and what ends it there."""
        last, limits, ranges = self.links(), self.limits, self.all
        e = np.flatnonzero(last == self.n)
        most = np.full(len(e), len(ranges))
        items = np.full(len(e), _FAR)
        size, due = items.copy(), items.copy()
        if limits.items is not None:
            items = self.base() + e + min(limits.items, 1 << 61) - 1
            most = np.minimum(most, np.searchsorted(ranges.rows, items, "right") - 1)
        if limits.bytes is not None:
            size = ranges.sizes[self.k] + self.upto[e] + limits.bytes
            most = np.minimum(most, np.searchsorted(ranges.sizes, size) - 1)
        if limits.age is not None:
            due, at = self.us[e] + limits.age, np.full(len(e), len(ranges))
            for q in range(len(ranges) - 1, self.k, -1):
                at[ranges.top[q] >= due] = q
            most = np.minimum(most, at)
        return pa.table({"_at": pa.array(most.astype(np.int32)), "_src": pa.array(self.base() + e), "_items": pa.array(items), "_bytes": pa.array(size), "_due": pa.array(due)})

    def answers(self, asked: pa.Table) -> pa.Table:
        """Links of batches left open elsewhere that end here, and of this range's first row: (source, range, beginning here, next source)."""
        src, y = np.array([-1 - self.k]), np.zeros(1, np.int64)
        if asked.num_rows:
            q = {c: asked.column(c).to_numpy() for c in ("_src", "_items", "_bytes", "_due")}
            last = np.full(len(q["_src"]), self.n)
            if self.limits.items is not None:
                last = np.minimum(last, q["_items"] - self.base())
            if self.limits.bytes is not None:
                last = np.minimum(last, np.searchsorted(self.upto, q["_bytes"] - self.all.sizes[self.k]) - 1)
            if self.limits.age is not None:
                last = np.minimum(last, np.searchsorted(self.top, q["_due"]))
            src, y = np.append(src, q["_src"]), np.append(y, last + 1)
        end = self.ends(self.links())[y]
        after = -2 - self.k if self.k + 1 < len(self.all) else _END
        to = np.where(end < self.n, self.base() + end, after)
        return pa.table({"_src": pa.array(src), "_at": pa.array(np.full(len(y), self.k, np.int32)), "_y": pa.array(y), "_to": pa.array(to)})

    def begins(self, y: int) -> pa.Table:
        last, at, out = self.links().tolist(), y, []
        while at < self.n:
            out.append(at)
            at = last[at] + 1
        return pa.table({"_p": pa.array(np.full(len(out), self.all.part(self.k)), pa.int32()), "_i": pa.array(self.place[out], pa.int64())})


def _entries(links: DataFrame, n: int, walk_limit: int) -> dict[int, int]:
    """For each range that the chain from the first row visits: where a batch begins there first."""
    few = links.limit(walk_limit + 1).toArrow()
    if few.num_rows <= walk_limit:
        to = {s: (k, y, t) for s, k, y, t in zip(*(few.column(c).to_pylist() for c in ("_src", "_at", "_y", "_to")))}
        at, out = -1, {}
        while at in to:
            k, y, at = to[at]
            out[k] = y
        return out
    # Doubling: after round r, ``far`` leads 2^r links ahead, and ``seen`` holds the sources within 2^r links.
    far = links.select("_src", "_to")
    seen = links.sparkSession.createDataFrame([(-1,)], "_src long")
    for _ in range(max(n - 1, 1).bit_length()):
        ahead = far.join(seen, "_src", "left_semi").select(F.col("_to").alias("_src"))
        seen = settled(seen.union(ahead).distinct())  # at most a source for each range
        twice = far.select(F.col("_src").alias("_via"), F.col("_to").alias("_end"))
        far = settled(far.join(twice, F.col("_to") == F.col("_via"), "left").select("_src", F.coalesce("_end", F.lit(_END)).alias("_to")))
    return {r["_at"]: r["_y"] for r in links.join(seen, "_src", "left_semi").collect()}


def batch_starts(rows: DataFrame, limits: Limits, walk_limit: int = 200_000, start: int | None = None) -> DataFrame:
    """``start``: the instant before the first row.  Gives (``_p``, ``_i``): range and place of the first item of each batch, for settled ``rows`` with ``_part``, ``_place``, ``_size`` (not negative) and ``_us`` (may be null)."""
    spark = rows.sparkSession
    thin = rows.select("_part", "_place", "_size", "_us")
    ranges = _Ranges(thin, start)
    if not len(ranges):
        return spark.createDataFrame([], "_p int, _i long")
    known = spark.createDataFrame([(int(p), k) for p, k in ranges.place.items()], "_of int, _at int")
    thin = thin.join(F.broadcast(known), F.col("_part") == F.col("_of")).drop("_of")  # a row for each range

    def ask(table):
        return _Range(table, ranges, limits).questions()

    def answer(table, asked):
        return _Range(table, ranges, limits).answers(asked) if table.num_rows else asked.select(["_src"]).slice(0, 0).append_column("_at", pa.array([], pa.int32())).append_column("_y", pa.array([], pa.int64())).append_column("_to", pa.array([], pa.int64()))

    asked = thin.groupBy("_part").applyInArrow(ask, "_at int, _src long, _items long, _bytes long, _due long").filter(F.col("_at") < len(ranges))
    links = settled(thin.groupBy("_at").cogroup(asked.groupBy("_at")).applyInArrow(answer, "_src long, _at int, _y long, _to long"))
    entry = _entries(links, len(ranges), walk_limit)

    def begin(table):
        r = _Range(table, ranges, limits)
        return r.begins(entry.get(r.k, r.n))

    return thin.groupBy("_part").applyInArrow(begin, "_p int, _i long")
