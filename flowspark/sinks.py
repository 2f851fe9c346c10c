"""Where a pipeline's rows go."""

from __future__ import annotations

import queue
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Sink:
    """``write`` gets all rows and the order columns once; ``flush`` and ``close`` follow on every path.  It may return how many rows it wrote."""

    def write(self, df: DataFrame, order: list[str]) -> int | None:
        raise NotImplementedError

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass


def in_order(df: DataFrame, order: list[str], single: bool = True) -> DataFrame:
    """``single``: one sorted partition, for sinks that take rows one by one anyway.

    A global sort samples its input first, which would run it, and what it
    observes, twice.
    """
    if not order:
        return df
    return df.repartition(1).sortWithinPartitions(*order) if single else df.orderBy(*order)


class NullSink(Sink):
    def write(self, df, order):
        df.write.format("noop").mode("overwrite").save()


class FnSink(Sink):
    """A function for each row on the driver, in order."""

    def __init__(self, fn: Callable[[Row], None]):
        self.fn = fn

    def write(self, df, order):
        n = 0
        for row in in_order(df, order).toLocalIterator():
            self.fn(row)
            n += 1
        return n


class PartitionSink(Sink):
    """A function for each partition's rows on the executors, without order."""

    def __init__(self, fn):
        self.fn = fn

    def write(self, df, order):
        df.foreachPartition(self.fn)


class SharedHandle:
    """What a :class:`VecSink` got, also after the run."""

    def __init__(self):
        self._rows: list[Row] = []

    def take(self) -> list[Row]:
        got, self._rows = self._rows, []
        return got

    def snapshot(self) -> list[Row]:
        return list(self._rows)

    def __len__(self) -> int:
        return len(self._rows)

    @property
    def is_empty(self) -> bool:
        return not self._rows


class VecSink(Sink):
    """Rows in the driver's memory; for small results."""

    def __init__(self):
        self._handle = SharedHandle()

    def handle(self) -> SharedHandle:
        return self._handle

    def write(self, df, order):
        rows = in_order(df, order).collect()
        self._handle._rows.extend(rows)
        return len(rows)


def _both(one: Callable[[], None], two: Callable[[], None]) -> None:
    """Both are called; of two errors the second is a note to the first."""
    try:
        one()
    except Exception as e:
        try:
            two()
        except Exception as other:
            e.add_note(f"and then: {other}")
        raise
    two()


class TeeSink(Sink):
    """Both sinks get all rows, computed once; if the first fails, the second is not written, and both are closed."""

    def __init__(self, first: Sink, second: Sink):
        self.first, self.second = first, second

    def into_inner(self) -> tuple[Sink, Sink]:
        return self.first, self.second

    def write(self, df, order):
        kept = df.persist()
        try:
            n = self.first.write(kept, order)
            m = self.second.write(kept, order)
            return n if n is not None else m if m is not None else kept.count()
        finally:
            kept.unpersist()

    def flush(self):
        _both(self.first.flush, self.second.flush)

    def close(self):
        _both(self.first.close, self.second.close)


class ChannelSink(Sink):
    """Rows into a bounded queue, in order; waits while it is full.

    A reader that goes shuts the queue down, which ends the run with a
    ``SinkError``, also while it waits; so does ``timeout`` on a full queue.
    """

    def __init__(self, to: queue.Queue, timeout: float | None = None):
        self.to, self.timeout = to, timeout

    def write(self, df, order):
        n = 0
        for row in in_order(df, order).toLocalIterator():
            self.to.put(row, timeout=self.timeout)
            n += 1
        return n


class WriterSink(Sink):
    """Lines of text under ``path``, sorted; ``single``: in one file, else in files whose names sort as the lines do."""

    def __init__(self, path: str, column: str = "value", single: bool = True):
        self.path, self.column, self.single = path, column, single

    def write(self, df, order):
        lines = in_order(df, order, self.single).select(F.col(self.column).cast("string").alias("value"))
        lines.write.mode("overwrite").text(self.path, lineSep="\n")


class TableSink(Sink):
    """Any format that Spark writes."""

    def __init__(self, path: str, format: str = "parquet", mode: str = "overwrite", **options):
        self.path, self.format, self.mode, self.options = path, format, mode, options

    def write(self, df, order):
        df.write.format(self.format).mode(self.mode).options(**self.options).save(self.path)
