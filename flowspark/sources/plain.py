"""Sources: each has ``read(spark)``, a DataFrame, and ``order``, the columns of its arrival order."""

from __future__ import annotations

import queue
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import numbered


class IterSource:
    """Rows (tuples) of an iterable on the driver."""

    order = ("seq",)

    def __init__(self, rows: Iterable[tuple], schema: str):
        self.rows, self.schema = rows, schema

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *r) for k, r in enumerate(self.rows)], "seq long, " + self.schema)


class FnSource:
    """Rows that a function makes where it runs, on an executor; it returns an iterator of dicts and may raise."""

    order = ("seq",)

    def __init__(self, fn: Callable[[], Iterator[dict]], schema: str):
        self.fn, self.schema = fn, schema

    def read(self, spark: SparkSession) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        full, fn = spark.createDataFrame([], "seq long, " + self.schema).schema, self.fn
        arrow = to_arrow_schema(full)

        def run(batches):
            held = []
            if sum(b.num_rows for b in batches):
                for k, row in enumerate(fn()):
                    held.append({"seq": k, **row})
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
            yield pa.RecordBatch.from_pylist(held, arrow)

        return spark.range(1).coalesce(1).mapInArrow(run, full)


class ChannelSource:
    """What a queue holds until its end mark (None), until it is shut down, or until nothing came for ``timeout`` seconds."""

    order = ("seq",)

    def __init__(self, items: queue.Queue, schema: str, timeout: float = 1.0):
        self.items, self.schema, self.timeout = items, schema, timeout

    def read(self, spark: SparkSession) -> DataFrame:
        got = []
        while True:
            try:
                item = self.items.get(timeout=self.timeout)
            except (queue.Empty, getattr(queue, "ShutDown", queue.Empty)):  # the latter from Python 3.13
                break
            if item is None:
                break
            got.append(item)
        return IterSource(got, self.schema).read(spark)


class ChainSource:
    """All rows of the first source, then all of the second."""

    order = ("source_no", "seq")

    def __init__(self, first, second):
        self.parts = (first, second)

    def read(self, spark: SparkSession) -> DataFrame:
        out = []
        for k, part in enumerate(self.parts):
            df = part.read(spark)
            if tuple(part.order) != ("seq",):
                df = numbered(df, list(part.order), "_seq").drop(*part.order).withColumnRenamed("_seq", "seq")
            out.append(df.withColumn("source_no", F.lit(k)))
        return out[0].unionByName(out[1])


class TableSource:
    """Any format that Spark reads, ordered by ``order``."""

    def __init__(self, path: str, order: list[str], format: str = "parquet", **options):
        self.path, self.order, self.format, self.options = path, tuple(order), format, options

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).options(**self.options).load(self.path)
