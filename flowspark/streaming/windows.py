"""Windows over a live stream, micro-batch after micro-batch, as over a table.

The grid starts at the stream's first row and is shared by all keys; time is
clamped to the running maximum of all rows, so late rows join the current
window and nothing is dropped by a watermark.  Rows of windows that are still
open are kept in a table under ``state``, one for each micro-batch, with the
anchor and the instant reached; a micro-batch that Spark runs again starts from
the same table as before.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grouping
from ..operators.emission import named_keys
from ..policies import WindowPolicy, WindowSpec, micros
from .state import StateLog, Version

_EPOCH = datetime(1970, 1, 1)
#: The clamped clock, next to the user's columns.
_AT = "__clock"


class StreamWindows:
    """A body for ``foreachBatch`` or :class:`StepRunner`; ``emit`` gets the windows that each call closes.

    ``aggregates`` are those of a group, as for a pipe's ``agg``.  A window
    closes when a row or :meth:`tick` brings time to its end, or, for sessions,
    further than the idle time past its last row, or when its key is put out for
    a new one at the cap on keys; :meth:`finish` closes the rest.
    """

    def __init__(self, spark: SparkSession, state: str, schema, order: list[str], clock: str, spec: WindowPolicy | WindowSpec, keys: list[str] = (), aggregates: tuple[Column, ...] = (), emit: Callable[[DataFrame, int], None] = lambda df, no: None):
        self.spark, self.log, self.order, self.clock, self.keys = spark, StateLog(spark, state), list(order), clock, list(keys)
        self.spec, self.aggregates, self.emit = WindowSpec.of(spec), aggregates, emit
        self.spec.validate("window")
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = [f.name for f in self.schema.fields]

    # -- state ----------------------------------------------------------------

    def _open_rows(self, version: Version | None) -> DataFrame:
        kept = [*self.schema.fields, type(self.schema.fields[0])(_AT, self.schema[self.clock].dataType)]
        schema = type(self.schema)(kept)
        return self.spark.createDataFrame([], schema) if version is None else self.log.read(version, "open", schema)

    def _sent(self, version: Version | None) -> None:
        """What the version closed goes out, if it has not yet."""
        if version is not None and not version.emitted:
            self.emit(self.spark.read.parquet(f"{self.log.path}/{version.name}/closed"), version.no)
            self.log.done(version)

    # -- running ---------------------------------------------------------------

    def __call__(self, df: DataFrame, no: int) -> None:
        base = self.log.latest(no)
        self._sent(base)
        meta = base.record if base else None
        us = F.unix_micros(F.col(self.clock).cast("timestamp"))
        first = df.agg(F.min_by(us, F.struct(*self.order))).first()[0]
        if first is None:
            return
        rows = df.select(*self.columns)
        if grouping.steady(rows, self.order, self.clock):
            rows = rows.withColumn(_AT, F.col(self.clock))
        else:
            rows = grouping.clamped(rows, self.order, self.clock, _AT)
        if meta is not None:
            rows = rows.withColumn(_AT, F.greatest(_AT, self._instant(F.lit(meta["now"]))))
        rows = grouping.settled(self._open_rows(base).unionByName(rows.select(*self.columns, _AT)))
        now = rows.agg(F.max(F.unix_micros(F.col(_AT).cast("timestamp")))).first()[0]  # open rows came earlier
        anchor = meta["anchor"] if meta is not None else first
        closed, left = self._parted(rows, anchor, None if meta is None else meta["now"], now)
        self._keep(no, closed, left, anchor, now)

    def tick(self, instant: datetime) -> None:
        """Time has come to ``instant`` without rows."""
        base = self.log.latest()
        self._sent(base)
        if base is not None and (now := micros(instant - _EPOCH)) > base.record["now"]:
            closed, left = self._parted(self._open_rows(base), base.record["anchor"], base.record["now"], now)
            self._keep(base.no, closed, left, base.record["anchor"], now)

    def idle(self, wait: timedelta) -> None:
        """Time has gone on by ``wait`` past the last row or tick."""
        base = self.log.latest()
        if base is not None:
            self.tick(_EPOCH + timedelta(microseconds=base.record["now"]) + wait)

    def finish(self) -> None:
        """Close what is open."""
        base = self.log.latest()
        self._sent(base)
        if base is not None:
            closed, left = self._parted(self._open_rows(base), base.record["anchor"], base.record["now"], None)
            self._keep(base.no, closed, left, base.record["anchor"], base.record["now"])

    def _keep(self, no: int, closed: DataFrame, left: DataFrame, anchor: int, now: int) -> None:
        self._sent(self.log.keep(no, {"closed": closed, "open": left}, {"anchor": anchor, "now": now}))

    def _instant(self, us: Column) -> Column:
        return F.timestamp_micros(us).cast(self.schema[self.clock].dataType)

    def _parted(self, rows: DataFrame, anchor: int, before: int | None, now: int | None) -> tuple[DataFrame, DataFrame]:
        """The windows of ``rows`` (a table) that close between two instants (all, if ``now`` is None), and the rows of those that stay open."""
        policy, gone = self.spec.policy, "__gone"
        got = grouping.with_windows(rows, [_AT, *self.order], _AT, self.spec, self.keys, True, anchor)
        marked = got.rows.withColumn(gone, F.lit(False))
        if got.evicted is not None:  # a live key has rows here, so the least recent one is known
            put_out = got.evicted.select(F.col("key").alias("__key"), F.col("lru").alias("__put"), F.lit(True).alias("__out"))
            on = named_keys(self.keys).eqNullSafe(F.col("__key")) & (F.col(grouping.inner("lru")) == F.col("__put"))
            marked = grouping.settled(got.rows.join(put_out, on, "left").withColumn(gone, F.coalesce("__out", F.lit(False))).drop("__key", "__put", "__out"))
        elif policy.kind == "session" and now is not None:
            marked = grouping.settled(marked)  # read four times
        out = got.finished(marked.groupBy(*got.by).agg(*self.aggregates, *[c.alias(n) for n, c in got.bounds.items()], F.max(gone).alias(gone)))
        if now is None and policy.kind == "session":
            return out.drop(gone), rows.limit(0)
        us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        if policy.kind == "session":
            group, names = [c for c in got.by if c != grouping.inner("chunk")], grouping.outer(got.by)
            ends = marked.groupBy(*[F.col(c).alias(f"__e{k}") for k, c in enumerate(group)]).agg((F.max(gone) | (F.lit(now) - F.max(us(_AT)) > micros(policy.size))).alias("__shut"))
            on, after = ([F.col(n.get(c, c)).eqNullSafe(F.col(f"__e{k}")) for k, c in enumerate(group)] for n in ({}, names))
            shut = ends.filter("__shut").drop("__shut")
            return out.join(shut, after, "left_semi").drop(gone), marked.join(shut, on, "left_anti").select(*rows.columns)
        end = us("window_end")
        closed = out if now is None else out.filter((end <= now) | F.col(gone))
        closed = (closed if before is None else closed.filter(end > before)).drop(gone)  # the others closed earlier
        if now is None:
            return closed, rows.limit(0)
        step, past = micros(policy.step or policy.size), us(_AT) - F.lit(anchor)
        last = F.lit(anchor) + past - F.pmod(past, F.lit(step)) + F.lit(micros(policy.size))  # the end of a row's last window
        if got.evicted is None:
            return closed, rows.filter(last > now)
        once = us(grouping.inner("window_end")) == last  # sliding: a row is in several windows
        return closed, marked.filter(once & (last > now) & ~F.col(gone)).select(*rows.columns)
