"""Custom stages over a live stream: rows, ticks and a flush, with a state that outlives the process."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StageError
from ..operators.stages import Stage
from ..policies import ErrorPolicy
from .state import StateLog, Version

_ALL, _NO, _ERR, _TYPE, _INPUT, _STATE = "__all", "out_no", "__err", "__type", "__input", "__state"


class StreamStage:
    """A body for ``foreachBatch`` or :class:`StepRunner` that runs ``stage`` over the rows of a stream.

    With ``keys``, each key has a copy of the stage and its own rows in order,
    so keys run side by side; without, one copy takes all rows.  The copies are
    pickled into a table after each call; a process that starts again, or a
    micro-batch that Spark runs again, goes on from them.  ``tick`` and
    ``finish`` call ``Stage.tick`` and ``Stage.flush`` of every copy.

    ``emit`` gets the rows of ``schema`` with the keys and ``out_no``, their
    order within a key and call.  What the stage raises falls under ``policy``:
    fail fast raises a ``StageError`` and keeps the state before the call; else
    the row is left out, and its failure goes to ``dead`` (stage, error,
    error_type, input) under the dead-letter policy.
    """

    def __init__(self, spark: SparkSession, state: str, in_schema, order: list[str], stage: Stage, schema: str, keys: list[str] = (), emit: Callable[[DataFrame, int], None] = lambda df, no: None, policy: ErrorPolicy = ErrorPolicy.FAIL_FAST, dead: Callable[[DataFrame, int], None] = lambda df, no: None, stage_id: str = "stage"):
        self.spark, self.log, self.order, self.stage = spark, StateLog(spark, state), list(order), stage
        self.keys, self.emit, self.policy, self.dead, self.stage_id = list(keys), emit, policy, dead, stage_id
        self.schema = spark.createDataFrame([], in_schema).schema
        self.columns = [f.name for f in self.schema.fields]
        by = [self.schema[k] for k in self.keys] or [T.StructField(_ALL, T.IntegerType())]
        self.by = [f.name for f in by]
        made = [f for f in spark.createDataFrame([], schema).schema.fields if f.name not in self.by]
        self.held = T.StructType([*by, T.StructField(_STATE, T.BinaryType())])
        text = [T.StructField(c, T.StringType()) for c in (_ERR, _TYPE, _INPUT)]
        self.out = T.StructType([*by, T.StructField(_NO, T.LongType()), *made, *text, T.StructField(_STATE, T.BinaryType())])
        self.shown = [*self.keys, _NO, *(f.name for f in made)]

    def _ran(self, base: Version | None, rows: DataFrame, call: str) -> DataFrame:
        """Each key's state and then its rows in order, in one task as a stream: neither keys nor rows of a key are held together."""
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, by, order, template = to_arrow_schema(self.out), self.by, self.order, pickle.dumps(self.stage)
        columns, policy = self.columns, self.policy

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[dict] = []
            now, key, stage, held, count, stopped = None, {}, None, template, 0, False

            def made(make: Callable[[], Iterator[dict]], row: dict | None) -> bool:
                nonlocal count
                try:
                    for r in make():
                        out.append({**key, _NO: count, **r})
                        count += 1
                except Exception as e:
                    given = json.dumps(row, default=str) if row is not None else None
                    out.append({**key, _NO: count, _ERR: str(e), _TYPE: type(e).__name__, _INPUT: given})
                    count += 1
                    return policy is not ErrorPolicy.FAIL_FAST
                return True

            def ended() -> None:
                nonlocal stage
                if call and stage is None:
                    stage = pickle.loads(held)
                if call == "tick":
                    made(stage.tick, None)
                elif call == "finish":
                    made(stage.flush, None)
                out.append({**key, _STATE: held if stage is None else pickle.dumps(stage)})

            for b in batches:
                *values, states = (c.to_pylist() for c in b.columns)
                firsts, rows = list(zip(*values[: len(by)])), list(zip(*values[len(by) :]))
                for first, row, state in zip(firsts, rows, states):
                    if first != now and (now is None or repr(first) != repr(now)):  # NaN is one key
                        if now is not None:
                            ended()
                        now, key = first, dict(zip(by, first))
                        stage, held, count, stopped = None, template if state is None else state, 0, False
                    if state is None and not stopped:
                        if stage is None:
                            stage = pickle.loads(held)
                        item = dict(zip(columns, row))
                        stopped = not made(lambda: stage.process(item), item)  # noqa: B023
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out.clear()
            if now is not None:
                ended()
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

        rows = rows if self.keys else rows.withColumn(_ALL, F.lit(0))
        held = self.spark.createDataFrame([], self.held) if base is None else self.log.read(base, "state", self.held)
        names, owns = [f"k{j}" for j in range(len(by))], [f"u{j}" for j in range(len(columns))]
        some = rows.select(*[F.col(c).alias(k) for c, k in zip(by, names)], *[F.col(c).alias(u) for c, u in zip(columns, owns)], F.lit(None).cast("binary").alias("state"))
        before = held.select(*[F.col(c).alias(k) for c, k in zip(by, names)], *[F.lit(None).cast(self.schema[c].dataType).alias(u) for c, u in zip(columns, owns)], F.col(_STATE).alias("state"))
        both = some.unionByName(before)
        for f, k in zip(self.out, names):
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                both = both.withColumn(k, F.col(k) + F.lit(0).cast(f.dataType))  # -0.0 and 0.0 are one key
        at = dict(zip(columns, owns))
        both = both.repartition(*names).sortWithinPartitions(*names, F.col("state").isNull(), *[F.asc_nulls_last(at[c]) for c in order])
        return both.mapInArrow(run, self.out)

    def _sent(self, version: Version | None) -> None:
        if version is not None and not version.emitted:
            out = self.log.read(version, "out", self.out)
            self.emit(out.filter(F.col(_ERR).isNull()).select(*self.shown), version.no)
            if self.policy is ErrorPolicy.DEAD_LETTER:
                failed = out.filter(F.col(_ERR).isNotNull())
                self.dead(failed.select(F.lit(self.stage_id).alias("stage"), F.col(_ERR).alias("error"), F.col(_TYPE).alias("error_type"), F.col(_INPUT).alias("input")), version.no)
            self.log.done(version)

    def _step(self, base: Version | None, rows: DataFrame, no: int, call: str) -> None:
        from ..functions.shared import settled

        out = settled(self._ran(base, rows, call))
        if self.policy is ErrorPolicy.FAIL_FAST:
            first = out.filter(F.col(_ERR).isNotNull()).select(*self.by, _NO, _ERR).orderBy(*self.by, _NO).first()
            if first is not None:
                raise StageError(self.stage_id, first[_ERR])
        state = out.filter(F.col(_STATE).isNotNull()).select(*self.by, _STATE)
        self._sent(self.log.keep(no, {"out": out.filter(F.col(_STATE).isNull()), "state": state}, {}))

    # -- running ---------------------------------------------------------------

    def __call__(self, df: DataFrame, no: int) -> None:
        base = self.log.latest(no)
        self._sent(base)
        self._step(base, df.select(*self.columns), no, "")

    def tick(self, instant: datetime | None = None) -> None:
        self._end("tick")

    def idle(self, wait: timedelta) -> None:
        self._end("tick")

    def finish(self) -> None:
        self._end("finish")

    def _end(self, call: str) -> None:
        base = self.log.latest()
        self._sent(base)
        self._step(base, self.spark.createDataFrame([], self.schema), base.no if base else -1, call)
