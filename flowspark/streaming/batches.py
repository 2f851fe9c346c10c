"""Batches over a live stream, micro-batch after micro-batch, as over a table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import settled
from ..operators import grouping
from ..policies import BatchPolicy, micros
from .state import StateLog, Version

_EPOCH = datetime(1970, 1, 1)
#: Columns of this module next to the user's.
_TURN, _FULL = "__turn", grouping.BATCH
_LAST = 1 << 62


class StreamBatches:
    """A body for ``foreachBatch`` or :class:`StepRunner`; ``emit`` gets the batches that each call closes, by ``batch_id``.

    Rows arrive by micro-batch and, within it, in ``order``.  A batch closes at
    the row that reaches a limit; one with a limit of age also by :meth:`tick`
    or :meth:`idle`, once it has been open that long; :meth:`finish` closes the
    rest.  Rows of the open batch, which its limits bound, are kept between
    calls, so a call costs what it brings.  ``emit`` may see a version again
    after a crash, with the same ids.
    """

    def __init__(self, spark: SparkSession, state: str, schema, order: list[str], policy: BatchPolicy, size: Column | None = None, clock: str | None = None, aggregates: tuple[Column, ...] = (), emit: Callable[[DataFrame, int], None] = lambda df, no: None):
        policy.validate("batch", size is not None)
        self.spark, self.log, self.order, self.clock = spark, StateLog(spark, state), list(order), clock
        self.policy, self.size, self.aggregates, self.emit = policy, size, aggregates, emit
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = [f.name for f in self.schema.fields]

    # -- state -----------------------------------------------------------------

    def _open_rows(self, version: Version | None) -> DataFrame:
        schema = self._with(_TURN)
        return self.spark.createDataFrame([], schema) if version is None else self.log.read(version, "open", schema)

    def _with(self, name: str) -> T.StructType:
        return T.StructType([*(T.StructField(f.name, f.dataType) for f in self.schema.fields), T.StructField(name, T.LongType())])

    def _closed(self, version: Version) -> DataFrame:
        rows = self.log.read(version, "closed", self._with("batch_id"))
        return rows.groupBy("batch_id").agg(*self.aggregates, F.count(F.lit(1)).alias("n_items")) if self.aggregates else rows

    def _sent(self, version: Version | None) -> None:
        """What the version closed goes out, if it has not yet."""
        if version is not None and not version.emitted:
            if version.record["closed"] > version.record["before"]:
                self.emit(self._closed(version), version.no)
            self.log.done(version)

    def _keep(self, no: int, closed: DataFrame, left: DataFrame, before: int, count: int, opened: int | None, now: int | None) -> None:
        tables = {"closed": closed.select(*self.columns, "batch_id"), "open": left.select(*self.columns, _TURN)}
        self._sent(self.log.keep(no, tables, {"before": before, "closed": count, "opened": opened, "now": now}))

    # -- running ---------------------------------------------------------------

    def __call__(self, df: DataFrame, no: int) -> None:
        base = self.log.latest(no)
        self._sent(base)
        record = base.record if base else {"closed": 0, "opened": None, "now": None}
        rows = self._open_rows(base).unionByName(df.select(*self.columns).withColumn(_TURN, F.lit(no).cast("long")))
        # A row behind the last: where it begins a batch, the last one is closed.
        nothing = self.spark.createDataFrame([(*(None for _ in self.columns), _LAST)], self._with(_TURN))
        size = None if self.size is None else F.when(F.col(_TURN) == _LAST, F.lit(0)).otherwise(self.size)
        got = settled(grouping.with_batch_id(rows.unionByName(nothing), [_TURN, *self.order], self.policy, size, self.clock, record["opened"]))
        open_id = got.filter(F.col(_TURN) == _LAST).first()[_FULL]
        got = got.filter(F.col(_TURN) < _LAST)
        closed = got.filter(F.col(_FULL) < open_id).withColumn("batch_id", F.col(_FULL) + record["closed"])
        opened, now = self._instants(got, open_id, record)
        self._keep(no, closed, got.filter(F.col(_FULL) == open_id), record["closed"], record["closed"] + open_id, opened, now)

    def _instants(self, got: DataFrame, open_id: int, record: dict) -> tuple[int | None, int | None]:
        """When the open batch was opened, and the last instant known; a null clock is the instant before it."""
        if self.clock is None:
            return None, None
        us, at = F.unix_micros(F.col(self.clock).cast("timestamp")), F.struct(_TURN, *self.order)
        shut = F.when(us.isNotNull() & (F.col(_FULL) < open_id), at)
        own, before, last = got.agg(F.min_by(us, F.when(F.col(_FULL) == open_id, at)), F.max_by(us, shut), F.max_by(us, F.when(us.isNotNull(), at))).first()
        opened = next((x for x in (own, before, record["opened"]) if x is not None), None)
        return opened, record["now"] if last is None else last

    def tick(self, instant: datetime) -> None:
        """Time has come to ``instant`` without rows: the open batch closes if it is old enough."""
        self._until(micros(instant - _EPOCH))

    def idle(self, wait: timedelta) -> None:
        """Time has gone on by ``wait`` past the last row or tick."""
        base = self.log.latest()
        if base is not None and base.record["now"] is not None:
            self._until(base.record["now"] + micros(wait))

    def _until(self, now: int) -> None:
        base = self.log.latest()
        self._sent(base)
        if base is None or self.policy.age_limit is None or self.clock is None:
            return
        opened = base.record["opened"]
        old = opened is not None and now - opened >= micros(self.policy.age_limit)
        self._shut(base, old, max(now, base.record["now"] or now))

    def finish(self) -> None:
        """Close what is open."""
        base = self.log.latest()
        self._sent(base)
        if base is not None:
            self._shut(base, True, base.record["now"])

    def _shut(self, base: Version, old: bool, now: int | None) -> None:
        rows, count = self._open_rows(base), base.record["closed"]
        some = old and not rows.isEmpty()
        closed = rows.withColumn("batch_id", F.lit(count).cast("long")).filter(F.lit(some))
        self._keep(base.no, closed, rows.filter(F.lit(not some)), count, count + int(some), base.record["opened"], now)
