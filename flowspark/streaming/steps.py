"""Running a pipe over a stream step by step, one micro-batch a step."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from ..errors import Cancelled, Closed, StageError


class Step(Enum):
    ITEM = "item"
    IDLE = "idle"
    DONE = "done"


class StepRunner:
    """Micro-batches of a folder of files, one file each, through ``body(df, step_no)``.

    Each step is an ``availableNow`` run over one more file with a checkpoint,
    so a runner that is made again with the same checkpoint goes on where the
    last one ended.  ``finish`` takes what is left, lets the body finish and
    ends.  A body with ``tick`` and ``finish``, such as ``StreamWindows``, gets
    those calls; with ``idle``, a step that finds nothing is an idle tick.
    """

    def __init__(self, spark: SparkSession, path: str, schema, checkpoint: str, body: Callable[[DataFrame, int], None], format: str = "parquet", idle: timedelta | None = None):
        self.spark, self.body, self.checkpoint, self.idle = spark, body, checkpoint, idle
        self.path, self.schema, self.format = path, schema, format
        self.steps = self.rows_in = 0
        self.failed = self.done = self.cancelled = False

    def _stream(self, each: int | None) -> DataFrame:
        reader = self.spark.readStream.format(self.format).schema(self.schema)
        if each:
            reader = reader.option("maxFilesPerTrigger", each)
        return reader.load(self.path)

    def _run(self, each: int | None, most: int | None) -> None:
        ran: list[int] = []

        def one(df: DataFrame, no: int) -> None:
            if most is not None and len(ran) >= most:
                raise _Enough()  # this micro-batch stays for the next step
            kept = df.persist()
            try:
                n = kept.count()
                if n:
                    self.body(kept, no)
                self.rows_in += n
                ran.append(no)
            finally:
                kept.unpersist()

        query = self._stream(each).writeStream.foreachBatch(one).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            if most is None or len(ran) < most:
                self.failed = True
                raise StageError("stream", e) from e

    def _open(self) -> None:
        if self.cancelled:
            raise Cancelled()
        if self.failed:
            raise Closed()

    def cancel(self) -> None:
        self.cancelled = True

    def step(self) -> Step:
        self._open()
        if self.done:
            return Step.DONE
        before = self.rows_in
        self._run(1, 1)
        self.steps += 1
        if self.rows_in > before:
            return Step.ITEM
        if self.idle is not None:
            self.tick()
        return Step.IDLE

    def tick(self, instant: datetime | None = None) -> None:
        """Let the body see that time has passed: to ``instant``, or by the idle time."""
        self._open()
        if instant is None and hasattr(self.body, "idle"):
            self.body.idle(self.idle or timedelta(0))
        elif hasattr(self.body, "tick"):
            self.body.tick(instant)
        else:
            self.body(self.spark.createDataFrame([], self.schema), -1)

    def finish(self) -> int:
        """All that is left; returns the rows read in all."""
        self._open()
        if not self.done:
            self._run(None, None)
            if hasattr(self.body, "finish"):
                self.body.finish()
            self.done = True
        return self.rows_in

    @property
    def is_finished(self) -> bool:
        return self.done


class _Enough(Exception):
    pass
