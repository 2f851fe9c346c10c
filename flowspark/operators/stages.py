"""Custom stateful stages over rows in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Stage:
    """Subclass and override; rows are dicts, and each method yields any number of rows.

    The state lives in one task, as the order is total; where a set-based form
    exists (a running sum, numbers, groups), use that instead.  What a method
    raises falls under the pipe's error policy: the rows it has yielded before
    stay, and the next row goes to the same stage.
    """

    def process(self, row: dict) -> Iterator[dict]:
        yield row

    def tick(self) -> Iterator[dict]:
        """For runs step by step: time has passed without a row."""
        return iter(())

    def flush(self) -> Iterator[dict]:
        return iter(())


def run_stage(df: DataFrame, order: list[str], stage: Stage, schema: str, keep: bool = False) -> DataFrame:
    """Output rows of ``schema`` with ``out_no``, their order; failures have ``_err``, ``_type`` and, with ``keep``, their ``_input``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    full = df.sparkSession.createDataFrame([], "out_no long, " + schema + ", _err string, _type string, _tries int, _input string").schema
    arrow = to_arrow_schema(full)

    def run(batches):
        held, no = [], 0

        def made(make, row):
            nonlocal no
            try:
                for r in make():
                    held.append({"out_no": no, **r, "_tries": 1})
                    no += 1
            except Exception as e:
                held.append({"out_no": no, "_err": str(e), "_type": type(e).__name__, "_tries": 1, "_input": json.dumps(row, default=str) if keep and row is not None else None})
                no += 1

        for b in batches:
            for row in b.to_pylist():
                made(lambda: stage.process(row), row)
            yield pa.RecordBatch.from_pylist(held, arrow)
            held.clear()
        made(stage.flush, None)
        yield pa.RecordBatch.from_pylist(held, arrow)

    return df.repartition(1).sortWithinPartitions(*order).mapInArrow(run, full)
