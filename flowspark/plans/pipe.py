"""The builder: an ordered stream of records, its transforms, and the run."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Cancelled, Closed, ConfigError, ConfigErrorKind, DriverError, FlowError, SinkError, SourceError, StageError, StageFailure
from ..operators import grouping
from ..operators.stages import Stage, run_stage
from ..policies import BatchPolicy, ErrorPolicy, RetryPolicy, WindowPolicy, WindowSpec, check_buffer, micros
from ..sinks import Sink

DEAD = T.StructType([T.StructField("stage", T.StringType()), T.StructField("error", T.StringType()), T.StructField("error_type", T.StringType()), T.StructField("input", T.StringType()), T.StructField("attempts", T.IntegerType())])


@dataclass(frozen=True)
class RunStats:
    items_in: int = 0
    items_out: int = 0
    errors: int = 0
    dead_lettered: int = 0
    retries: int = 0
    duration: timedelta = timedelta(0)


@dataclass(frozen=True)
class Event:
    """``kind``: started, stage_error, retry, dead_lettered, teardown_error or finished.

    ``teardown_error``: closing a sink failed after the run had failed already;
    the run raises its first error.
    """

    kind: str
    stage: str | None = None
    count: int = 0
    error: str | None = None
    stats: RunStats | None = None


class CancelHandle:
    def __init__(self, spark: SparkSession, tag: str):
        self._spark, self._tag, self._set = spark, tag, threading.Event()

    def cancel(self) -> None:
        self._set.set()
        self._spark.sparkContext.cancelJobsWithTag(self._tag)  # a session's own tags are known to the thread that set them only

    @property
    def is_cancelled(self) -> bool:
        return self._set.is_set()


@dataclass(frozen=True)
class _Fallible:
    stage: str
    policy: ErrorPolicy
    rows: DataFrame  # with _err, _type, _tries and, where kept, _input
    order: tuple[str, ...]


@dataclass(frozen=True)
class Pipe:
    """Immutable: each operator returns a new pipe over a new lazy DataFrame.

    ``order`` names the columns that give the arrival order; ``clock`` the one
    that windows and ages read.  Order columns stay with the rows until a batch
    or window makes new ones.
    """

    df: DataFrame
    order: tuple[str, ...]
    clock: str | None = None
    source: str = "source"
    source_df: DataFrame | None = None
    next_stage: str | None = None
    policy: ErrorPolicy = ErrorPolicy.FAIL_FAST
    fallible: tuple[_Fallible, ...] = ()
    dead_sink: Sink | None = None
    observers: tuple[Callable[[Event], None], ...] = ()
    error: ConfigError | None = None
    idle: timedelta | None = None
    late: Callable[[DataFrame], DataFrame] | None = None  # turns the mark of window groups into their place, once something reads the order

    # -- sources ------------------------------------------------------------

    @classmethod
    def from_df(cls, df: DataFrame, order_by: list[str] | str, clock: str | None = None) -> "Pipe":
        order = (order_by,) if isinstance(order_by, str) else tuple(order_by)
        return cls(df, order, clock, source_df=df)

    @classmethod
    def from_iter(cls, spark: SparkSession, rows, schema: str, clock: str | None = None) -> "Pipe":
        """Rows (tuples) in the order of the iterable, numbered by ``seq``."""
        numbered = [(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)]
        return cls.from_df(spark.createDataFrame(numbered, "seq long, " + schema), "seq", clock)

    @classmethod
    def from_source(cls, source, spark: SparkSession, clock: str | None = None, source_id: str = "source") -> "Pipe":
        """From an object with ``read(spark)``, a DataFrame, and ``order``, its order columns; what it raises comes under ``source_id``."""
        try:
            return cls.from_df(source.read(spark), source.order, clock).source_id(source_id)
        except FlowError:
            raise
        except Exception as e:
            raise SourceError(source_id, e) from e

    # -- settings -----------------------------------------------------------

    def stage_id(self, name: str) -> "Pipe":
        return replace(self, next_stage=name)

    def source_id(self, name: str) -> "Pipe":
        return replace(self, source=name)

    def on_error(self, policy: ErrorPolicy) -> "Pipe":
        """For fallible stages added after it."""
        return replace(self, policy=policy)

    def dead_letter(self, sink: Sink) -> "Pipe":
        return replace(self, dead_sink=sink)

    def observe(self, on_event: Callable[[Event], None]) -> "Pipe":
        return replace(self, observers=(*self.observers, on_event))

    def idle_tick(self, interval: timedelta) -> "Pipe":
        """Checked here; a stream's processing-time trigger uses it."""
        return self._checked(lambda: None if micros(interval) > 0 else _raise(ConfigErrorKind.ZERO_DURATION, self.source), idle=interval)

    def buffer(self, capacity: int) -> "Pipe":
        """A bound on the rows between stages, which does not change results; Spark plans its own."""
        name = self.next_stage or "buffer"
        return self._checked(lambda: check_buffer(capacity, name))

    def _checked(self, check: Callable[[], None], **more) -> "Pipe":
        try:
            check()
        except ConfigError as e:
            return replace(self, error=self.error or e, next_stage=None)
        return replace(self, next_stage=None, **more)

    def _to(self, df: DataFrame, **more) -> "Pipe":
        return replace(self, df=df, next_stage=None, **more)

    def in_order(self) -> "Pipe":
        """The same with order columns that sort: groups of windows in the order in which they come out."""
        return self if self.late is None else replace(self, df=self.late(self.df), late=None)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.order]

    # -- records ------------------------------------------------------------

    def map(self, *exprs: Column | str, fn: Callable[[dict], dict] | None = None, schema: str | None = None) -> "Pipe":
        """New columns from expressions; or from ``fn``, a row as dict to a dict, with the ``schema`` of what it returns.  Order and clock columns stay."""
        if fn is not None:
            return self._to(_by_rows(self, lambda r: (fn(r),), schema))
        keep = [c for c in (*self.order, *([self.clock] if self.clock else [])) if c not in {_name(self.df, e) for e in exprs}]
        return self._to(self.df.select(*keep, *exprs))

    def with_columns(self, **exprs: Column) -> "Pipe":
        return self._to(self.df.withColumns(exprs))

    def filter(self, test: Column | str | Callable[[dict], bool]) -> "Pipe":
        """Rows for which ``test`` is true; null is not."""
        if callable(test) and not isinstance(test, Column):
            return self._to(_by_rows(self, lambda r: (r,) if test(r) else (), None))
        return self._to(self.df.filter(test))

    def filter_map(self, name: str, expr: Column) -> "Pipe":
        """``name`` set to ``expr``; rows where that is null go."""
        return self._to(self.df.withColumn(name, expr).filter(F.col(name).isNotNull()))

    def flat_map(self, name: str, expr: Column) -> "Pipe":
        """A row for each item of the array ``expr``, in order; none for an empty array or null."""
        pos = f"_pos{len(self.order)}"
        keep = [c for c in self.df.columns if c != name]
        return self._to(self.df.select(*keep, F.posexplode(expr).alias(pos, name)), order=(*self.order, pos))

    def inspect(self, name: str, *aggregates: Column) -> tuple["Pipe", Observation]:
        """Aggregates seen in passing; read ``.get`` of the observation after a run."""
        seen = Observation(name)
        return self._to(self.df.observe(seen, *aggregates)), seen

    def chain(self, other: "Pipe") -> "Pipe":
        """All rows of this pipe, then all of the other."""
        if self.late or other.late:
            return self.in_order().chain(other.in_order())
        both = self.df.withColumn("_src", F.lit(0)).unionByName(other.df.withColumn("_src", F.lit(1)))
        return self._to(both, order=("_src", *self.order), source_df=None if self.source_df is None else both)

    def stage(self, stage: Stage, schema: str) -> "Pipe":
        """A stateful stage over all rows in order: one task, see :mod:`flowspark.operators.stages`.  What it raises falls under the error policy."""
        if self.late:
            return self.in_order().stage(stage, schema)
        rows = run_stage(self.df, list(self.order), stage, schema, self.policy is ErrorPolicy.DEAD_LETTER)
        return replace(self, order=("out_no",), clock=None)._split("stage", rows)

    # -- fallible -----------------------------------------------------------

    def try_map(self, name: str, expr: Column, error: str = "no value", fails: Column | None = None) -> "Pipe":
        """``name`` set to ``expr``; a row fails where ``fails`` is true (else: where ``expr`` is null).  Dead letters have no input."""
        return self._try("try_map", name, expr, error, fails, False)

    def try_map_ref(self, name: str, expr: Column, error: str = "no value", fails: Column | None = None) -> "Pipe":
        """The same; dead letters keep the input."""
        return self._try("try_map_ref", name, expr, error, fails, True)

    def _try(self, default: str, name: str, expr: Column, error: str, fails: Column | None, keep: bool) -> "Pipe":
        if self.late:
            return self.in_order()._try(default, name, expr, error, fails, keep)
        bad = fails if fails is not None else expr.isNull()
        whole = F.to_json(F.struct(*self.columns)) if self.columns else F.lit(None).cast("string")
        given = whole if keep and self.policy is ErrorPolicy.DEAD_LETTER else F.lit(None).cast("string")
        rows = self.df.withColumns({"_input": given, "_err": F.when(bad, F.lit(error)), "_type": F.when(bad, F.lit("Error")), "_tries": F.lit(1)}).withColumn(name, expr)
        return self._split(default, rows)

    def try_map_py(self, fn: Callable[[dict], dict], schema: str, retry: RetryPolicy | None = None) -> "Pipe":
        """Rows from a Python function that may raise, tried as often as ``retry`` says; effects of a task that Spark runs again are repeated."""
        if self.late:
            return self.in_order().try_map_py(fn, schema, retry)
        default = "try_map_ref" if retry is None else "try_map_retry"
        name = self.next_stage or default
        if retry is not None:
            try:
                retry.validate(name)
            except ConfigError as e:
                return replace(self, error=self.error or e, next_stage=None)
        keep = self.policy is ErrorPolicy.DEAD_LETTER
        order, columns = self.order, self.columns

        def attempt(row: dict):
            tries, most = 0, retry.max_attempts if retry else 1
            while True:
                tries += 1
                try:
                    got = {"_err": None, "_type": None, **fn(row)}
                except Exception as e:
                    if tries < most:
                        time.sleep(retry.delay(tries).total_seconds())
                        continue
                    got = {"_err": str(e), "_type": type(e).__name__}
                given = json.dumps({c: row[c] for c in columns}, default=str) if keep and got["_err"] is not None else None
                return ({**{o: row[o] for o in order}, **got, "_tries": tries, "_input": given},)

        rows = _by_rows(self, attempt, schema + ", _err string, _type string, _tries int, _input string")
        return self._split(default, rows.persist())  # one run of ``fn`` for values and failures; a run lets go of it

    def try_map_retry(self, retry: RetryPolicy, fn: Callable[[dict], dict], schema: str) -> "Pipe":
        return self.try_map_py(fn, schema, retry)

    def _split(self, default: str, rows: DataFrame) -> "Pipe":
        name = self.next_stage or default
        good = rows.filter("_err is null").drop("_err", "_type", "_tries", "_input")
        return self._to(good, fallible=(*self.fallible, _Fallible(name, self.policy, rows, self.order)))

    @property
    def dead_letters(self) -> DataFrame:
        """Failures of all stages under the dead-letter policy."""
        return self._failures(lambda f: f.policy is ErrorPolicy.DEAD_LETTER)

    @property
    def failures(self) -> DataFrame:
        return self._failures(lambda f: True)

    def _failures(self, of: Callable[[_Fallible], bool]) -> DataFrame:
        out = self.df.sparkSession.createDataFrame([], DEAD)
        for f in filter(of, self.fallible):
            out = out.union(f.rows.filter("_err is not null").select(F.lit(f.stage), "_err", "_type", "_input", F.col("_tries").cast("int")))
        return out

    # -- groups -------------------------------------------------------------

    def batch(self, policy: BatchPolicy, clock: str | None = None) -> "Grouped":
        return self._batch(policy, None, clock, "batch")

    batch_with = batch

    def batch_bytes(self, policy: BatchPolicy, size: Column, clock: str | None = None) -> "Grouped":
        """``size``: bytes of an item, for text ``octet_length``."""
        return self._batch(policy, size, clock, "batch")

    batch_bytes_with = batch_bytes

    def _batch(self, policy: BatchPolicy, size: Column | None, clock: str | None, default: str) -> "Grouped":
        if self.late:
            return self.in_order()._batch(policy, size, clock, default)
        name = self.next_stage or default
        pipe = self._checked(lambda: policy.validate(name, size is not None))
        if pipe.error:
            return Grouped(pipe, pipe.df.withColumn(grouping.BATCH, F.lit(0).cast("long")), [grouping.BATCH])
        return Grouped(pipe, grouping.with_batch_id(self.df, list(self.order), policy, size, clock or self.clock), [grouping.BATCH])

    def window(self, spec: WindowPolicy | WindowSpec, clock: str | None = None, monotone: bool = False) -> "Grouped":
        return self.window_by_key([], spec, clock, monotone)

    window_with = window

    def window_by_key(self, keys: list[str] | str, spec: WindowPolicy | WindowSpec, clock: str | None = None, monotone: bool = False) -> "Grouped":
        if self.late:
            return self.in_order().window_by_key(keys, spec, clock, monotone)
        keys = [keys] if isinstance(keys, str) else list(keys)
        name, spec = self.next_stage or "window", WindowSpec.of(spec)
        pipe = self._checked(lambda: spec.validate(name))
        group = grouping.group_columns(keys)
        if pipe.error:
            return Grouped(pipe, pipe.df.withColumns({c: F.lit(0) for c in group if c not in keys}), group)
        got = grouping.with_windows(self.df, list(self.order), clock or self.clock, spec, keys, monotone)
        return Grouped(pipe, got.rows, got.by, got)

    window_by_key_with = window_by_key

    # -- the end ------------------------------------------------------------

    def sink(self, sink: Sink) -> "Pipeline":
        """A configuration error waits for the run."""
        return Pipeline(self, sink)

    def try_sink(self, sink: Sink) -> "Pipeline":
        """A configuration error is raised now."""
        made = Pipeline(self, sink)
        if made.config_error:
            raise made.config_error
        return made


@dataclass(frozen=True)
class Grouped:
    """Rows with their group; ``agg`` never builds arrays, ``items`` does."""

    pipe: Pipe
    df: DataFrame
    by: list[str]
    windowed: grouping.Windowed | None = None

    def agg(self, *aggregates: Column) -> Pipe:
        if self.windowed is None:
            out = self.df.groupBy(*self.by).agg(*aggregates, F.min(F.struct(*self.pipe.order)).alias("first_at"))
            return self.pipe._to(out.withColumnsRenamed(grouping.outer(self.by)), order=("first_at",), clock=None)
        w = self.windowed
        out = self.df.groupBy(*self.by).agg(*aggregates, *[c.alias(n) for n, c in {**w.bounds, **w.marks()}.items()])
        return self.pipe._to(w.finished(w.marked(out)), order=(grouping.MARK,), clock=None, late=w.arranged)

    def items(self, *columns: str) -> Pipe:
        """An array of structs in order, as ``items``, and ``n``."""
        wanted = list(columns) or [c for c in self.pipe.df.columns if c not in self.pipe.order]
        return self.agg(F.count(F.lit(1)).alias("n"), grouping.packed(list(self.pipe.order), wanted).alias("items"))


class Pipeline:
    """A finished pipe with its sink; runs once."""

    def __init__(self, pipe: Pipe, sink: Sink):
        pipe = pipe.in_order()
        self.pipe, self._sink, self._stats, self._done, self._failed = pipe, sink, RunStats(), False, False
        self._cancel: CancelHandle | None = None

    @property
    def config_error(self) -> ConfigError | None:
        if self.pipe.error:
            return self.pipe.error
        lost = next((f for f in self.pipe.fallible if f.policy is ErrorPolicy.DEAD_LETTER), None)
        return ConfigError(ConfigErrorKind.DEAD_LETTER_SINK_MISSING, lost.stage) if lost and self.pipe.dead_sink is None else None

    @property
    def is_finished(self) -> bool:
        return self._done

    def stats(self) -> RunStats:
        return self._stats

    def cancel_handle(self) -> CancelHandle:
        if self._cancel is None:
            self._cancel = CancelHandle(self.pipe.df.sparkSession, f"flowspark-{id(self)}")
        return self._cancel

    def run_with(self, driver) -> RunStats:
        """``driver`` has ``run(pipeline)``."""
        try:
            return driver.run(self)
        except FlowError:
            raise
        except Exception as e:
            raise DriverError(type(driver).__name__, e) from e

    def run_threaded(self) -> RunStats:
        """The same action: rows already flow through all partitions at once."""
        return self.run()

    def _tell(self, event: Event) -> None:
        for on_event in self.pipe.observers:
            on_event(event)

    def run(self) -> RunStats:
        if self._done or self._failed:
            raise Closed()
        if self.config_error:
            raise self.config_error
        spark, handle = self.pipe.df.sparkSession, self._cancel
        if handle:
            spark.sparkContext.addJobTag(handle._tag)
        error: BaseException | None = None
        try:
            self._stats = self._run()
        except BaseException as e:
            error = Cancelled(cause=e) if handle and handle.is_cancelled and not isinstance(e, Cancelled) else e
            if error is not e:
                error.__cause__ = e
        finally:
            if handle:
                spark.sparkContext.removeJobTag(handle._tag)
            for f in self.pipe.fallible:
                f.rows.unpersist()
        error = self._torn_down(error)
        if error is not None:
            self._failed = True
            self._tell(Event("finished", error=str(error)))
            raise error
        self._done = True
        self._tell(Event("finished", stats=self._stats))
        return self._stats

    def _torn_down(self, error: BaseException | None) -> BaseException | None:
        """Both sinks are closed, whatever happened; the first error stays, later ones become events."""
        for sink, stage in ((self._sink, "sink"), (self.pipe.dead_sink, "dead_letter")):
            for end in (sink.flush, sink.close) if sink is not None else ():
                try:
                    end()
                except Exception as e:
                    if error is None:
                        error = e if isinstance(e, FlowError) else SinkError(stage, e)
                    else:
                        self._tell(Event("teardown_error", stage, 1, str(e)))
        return error

    def _go_on(self) -> None:
        """Between jobs, as cancelling ends only those that run."""
        if self._cancel and self._cancel.is_cancelled:
            raise Cancelled()

    def _run(self) -> RunStats:
        self._go_on()
        began = time.monotonic()
        self._tell(Event("started"))
        pipe, out = self.pipe, self.pipe.df
        errors = retries = dead = 0
        fatal: tuple[_Fallible, Any] | None = None
        for f in pipe.fallible:
            self._go_on()
            row = f.rows.agg(F.count("_err").alias("errors"), F.coalesce(F.sum(F.col("_tries") - 1), F.lit(0)).alias("retries")).first()
            errors, retries = errors + row["errors"], retries + row["retries"]
            if row["retries"]:
                self._tell(Event("retry", f.stage, row["retries"]))
            if row["errors"]:
                self._tell(Event("stage_error", f.stage, row["errors"]))
                if f.policy is ErrorPolicy.FAIL_FAST and fatal is None:
                    fatal = f, f.rows.filter("_err is not null").orderBy(*f.order).select(*f.order, "_err").first()
        if fatal:
            f, first = fatal
            if set(f.order) <= set(out.columns):  # what came before the failure is kept
                at = F.struct(*[F.col(c) for c in f.order])
                self._write(self._sink, out.filter(at < F.struct(*[F.lit(first[c]).cast(f.rows.schema[c].dataType) for c in f.order])), pipe.order, "sink")
            raise StageError(f.stage, first["_err"])
        self._go_on()
        seen = Observation()
        count = self._write(self._sink, out.observe(seen, F.count(F.lit(1)).alias("n")), pipe.order, "sink")
        n = count if count is not None else seen.get["n"]
        if pipe.dead_sink is not None and any(f.policy is ErrorPolicy.DEAD_LETTER for f in pipe.fallible):
            letters = pipe.dead_letters
            dead = letters.count()
            self._write(pipe.dead_sink, letters, (), "dead_letter")
            self._tell(Event("dead_lettered", count=dead))
        items_in = pipe.source_df.count() if pipe.source_df is not None else n
        return RunStats(items_in, n, errors, dead, retries, timedelta(seconds=time.monotonic() - began))

    @staticmethod
    def _write(sink: Sink, df: DataFrame, order: tuple[str, ...], stage: str) -> int | None:
        try:
            return sink.write(df, list(order))
        except FlowError:
            raise
        except Exception as e:
            raise SinkError(stage, e) from e


class SyncDriver:
    def run(self, pipeline: Pipeline) -> RunStats:
        return pipeline.run()


class ThreadedDriver(SyncDriver):
    pass


def letters(rows: list) -> list[StageFailure]:
    """Dead-letter rows as objects."""
    return [StageFailure(r["stage"], r["error"], json.loads(r["input"]) if r["input"] else None, r["attempts"], r["error_type"]) for r in rows]


def _raise(kind: ConfigErrorKind, stage: str) -> None:
    raise ConfigError(kind, stage)


def _name(df: DataFrame, expr: Column | str) -> str:
    return expr if isinstance(expr, str) else df.select(expr).columns[0]


def _by_rows(pipe: Pipe, fn: Callable[[dict], Iterator[dict]], schema: str | None) -> DataFrame:
    """Rows through Python, a batch at a time; order columns and the clock are put back if ``fn`` leaves them out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [pipe.df.schema[c] for c in (*pipe.order, *([pipe.clock] if pipe.clock else []))]
    if schema is None:
        full = pipe.df.schema
    else:
        new = pipe.df.sparkSession.createDataFrame([], schema).schema
        full = T.StructType([*(f for f in kept if f.name not in new.names), *new.fields])
    arrow, names = to_arrow_schema(full), [f.name for f in kept]

    def run(batches):
        for b in batches:
            rows = [{**{n: r[n] for n in names}, **x} for r in b.to_pylist() for x in fn(r)]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return pipe.df.mapInArrow(run, full)
