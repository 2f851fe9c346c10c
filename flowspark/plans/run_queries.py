"""One query for each source, sink, way to run and stream operator, over the driver's tables, with its SQL twin."""

from __future__ import annotations

import math
import queue
import threading
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, StageError
from ..functions.shared import settled, shared_dir
from ..operators.grouping import numbered
from ..operators.stages import Stage
from ..policies import BatchPolicy, ErrorPolicy, LineOverflow, WindowPolicy
from ..sinks import ChannelSink, FnSink, NullSink, TableSink, TeeSink, VecSink, WriterSink
from ..sources import ByteLinesSource, ChainSource, ChannelSource, FnSource, IterSource, ReaderSource, TableSource
from ..streaming import Step, StepRunner, StreamBatches, StreamStage, StreamWindows
from .pipe import Pipe, ThreadedDriver
from .queries import _C, _K, _T0, _cents, _events, _greedy, _n, _parsed, _session, _table, _tumbling, whole

#: Rows that the sources on the driver read: fixed values.
WORDS = (("alpha", 3), ("beta", 1), ("gamma", 2))
SCHEMA = "word string, n long"
LIMIT = 120


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/flowspark/{uuid.uuid4().hex}"


def iter_source(spark, d):
    return Pipe.from_source(IterSource(WORDS, SCHEMA), spark).filter("n > 1").df


def from_iter(spark, d):
    return Pipe.from_iter(spark, WORDS, SCHEMA).map("word", (F.col("n") * 10).alias("n")).df


def channel_source(spark, d):
    items: queue.Queue = queue.Queue()
    for item in (*WORDS, None):
        items.put(item)
    return Pipe.from_source(ChannelSource(items, SCHEMA), spark).df


def fn_source(spark, d):
    """A generated sequence."""

    def squares():
        return ({"k": k, "square": k * k} for k in range(10_000))

    return Pipe.from_source(FnSource(squares, "k long, square long"), spark).filter("square % 3 = 1").df


def chain_source(spark, d):
    first, second = (TableSource(f"{d}/{t}.parquet", [k]) for t, k in (("nation", "n_nationkey"), ("region", "r_regionkey")))

    class Named:
        """The table's key and name under names that both parts share."""

        def __init__(self, part, key, name):
            self.part, self.order, self.name = part, [key], name

        def read(self, spark):
            return self.part.read(spark).select(self.order[0], F.col(self.name).alias("name"))

    chained = ChainSource(Named(first, "n_nationkey", "n_name"), Named(second, "r_regionkey", "r_name"))
    return Pipe.from_source(chained, spark).df.select(F.col("source_no").cast("long").alias("source_no"), "seq", "name")


def _lines(spark, d) -> str:
    path = _folder(spark)
    _table(spark, d, "documents").select(F.concat_ws("\t", "doc_id", F.regexp_replace("text", "[\r\n]", " ")).alias("value")).write.text(path)
    return path


def _doc(line):
    return F.substring_index(line, "\t", 1).cast("long").alias("doc_id")


def byte_lines(spark, d):
    """Lines of bytes, the long ones cut at the limit."""
    rows = Pipe.from_source(ByteLinesSource(_lines(spark, d), LIMIT, LineOverflow.TRUNCATE), spark).df
    return rows.select(_doc(F.col("line").cast("string")), F.octet_length("line").cast("long").alias("bytes"))


def line_overflow_skip(spark, d):
    rows = Pipe.from_source(ReaderSource(_lines(spark, d), 10 * LIMIT, LineOverflow.SKIP), spark).df
    return rows.select(_doc(F.col("line")), F.octet_length("line").cast("long").alias("bytes"))


def line_overflow_error(spark, d):
    """The number of the first line that is too long."""
    path = _folder(spark)
    lines = _table(spark, d, "region").select("r_regionkey", F.repeat(F.lit("x"), F.col("r_regionkey").cast("int") + 1).alias("value"))
    lines.coalesce(1).sortWithinPartitions("r_regionkey").select("value").write.text(path)
    try:
        ReaderSource(path, 3).read(spark)
    except Exception as e:
        return spark.createDataFrame([(type(e).__name__, e.line)], "error string, line long")
    return spark.createDataFrame([], "error string, line long")


def utf8_lossy(spark, d):
    """A byte that is no UTF-8 after each line becomes the replacement character."""
    path = _folder(spark)
    line = F.concat(F.concat_ws(" ", "event_id", "event_type").cast("binary"), F.lit(b"\xff"))
    _table(spark, d, "events").select(line.cast("string").alias("value")).write.text(path)
    rows = Pipe.from_source(ReaderSource(path, lossy=True), spark).df
    return rows.select(F.substring_index("line", " ", 1).cast("long").alias("event_id"), F.substring_index("line", " ", -1).alias("word"))


def tee_sink(spark, d):
    one, two = _folder(spark), _folder(spark)
    _events(spark, d).map(_cents().alias("cents")).sink(TeeSink(TableSink(one), TableSink(two))).run()
    copies = [spark.read.parquet(p).select(F.lit(k).cast("long").alias("copy"), "event_id", "cents") for k, p in enumerate((one, two))]
    return copies[0].union(copies[1])


def writer_sink(spark, d):
    """Lines in global order over many files."""
    path = _folder(spark)
    pipe = Pipe.from_df(_table(spark, d, "orders"), ["o_custkey", "o_orderkey"])
    pipe.map(F.concat_ws(" ", "o_custkey", "o_orderkey").alias("value")).sink(WriterSink(path, single=False)).run()
    source = ReaderSource(path)
    return numbered(source.read(spark), list(source.order), "row_no").select("row_no", "line")


def vec_sink(spark, d):
    out = VecSink()
    Pipe.from_df(_table(spark, d, "nation"), "n_nationkey").map("n_name").sink(out).run()
    return spark.createDataFrame([(k, r["n_name"]) for k, r in enumerate(out.handle().take())], "row_no long, name string")


def fn_sink(spark, d):
    """A running total on the driver, row by row in order."""
    totals: list[tuple[int, int]] = []

    def add(row):
        totals.append((row["n_nationkey"], row["n_regionkey"] + (totals[-1][1] if totals else 0)))

    Pipe.from_df(_table(spark, d, "nation"), "n_nationkey").map("n_regionkey").sink(FnSink(add)).run()
    return spark.createDataFrame(totals, "key long, total long")


def channel_sink(spark, d):
    """A queue of four rows between the run and its reader."""
    between: queue.Queue = queue.Queue(4)
    got: list = []
    reader = threading.Thread(target=lambda: [got.append((k, row["n_name"])) for k, row in enumerate(iter(between.get, None))])
    reader.start()
    Pipe.from_df(_table(spark, d, "nation"), "n_nationkey").map("n_name").sink(ChannelSink(between)).run()
    between.put(None)
    reader.join()
    return spark.createDataFrame(got, "row_no long, name string")


def fail_fast(spark, d):
    """What a run keeps that ends at the first failure."""
    path = _folder(spark)
    try:
        _parsed(spark, d, ErrorPolicy.FAIL_FAST).sink(TableSink(path)).run()
    except StageError:
        pass
    return spark.read.parquet(path).select("event_id", "k")


def dead_letter_sink(spark, d):
    """Good rows and dead letters, each in its sink."""
    good, bad = _folder(spark), _folder(spark)
    _parsed(spark, d, ErrorPolicy.DEAD_LETTER).dead_letter(TableSink(bad)).sink(TableSink(good)).run()
    user = F.get_json_object("input", "$.user_id").cast("long").alias("user_id")
    rows = spark.read.parquet(good).select("user_id", F.lit("kept").alias("fate"))
    return rows.union(spark.read.parquet(bad).select(user, F.lit("lost"))).groupBy("user_id", "fate").agg(_n())


def run_drivers(spark, d):
    """Each way to run takes and gives the same rows."""
    pipe = _events(spark, d).filter("value > 50")
    ways = (("run", lambda p: p.run()), ("run_threaded", lambda p: p.run_threaded()), ("run_with", lambda p: p.run_with(ThreadedDriver())))
    stats = [(name, way(pipe.sink(NullSink()))) for name, way in ways]
    return spark.createDataFrame([(name, s.items_in, s.items_out) for name, s in stats], "way string, items_in long, items_out long")


def events_observed(spark, d):
    seen: list = []
    _parsed(spark, d, ErrorPolicy.DEAD_LETTER).dead_letter(NullSink()).observe(seen.append).sink(NullSink()).run()
    return spark.createDataFrame([(k, e.kind, e.stage, e.count) for k, e in enumerate(seen)], "step long, kind string, stage string, n long")


def config_errors(spark, d):
    """What a pipe refuses before it runs, and the stage that is to blame."""
    pipe = Pipe.from_df(_table(spark, d, "region"), "r_regionkey", "r_regionkey").stage_id("here")
    day = timedelta(days=1)
    wrong = [
        pipe.batch(BatchPolicy()).items().sink(NullSink()),
        pipe.batch(BatchPolicy().max_items(0)).items().sink(NullSink()),
        pipe.batch(BatchPolicy().max_bytes(9)).items().sink(NullSink()),
        pipe.window(WindowPolicy.tumbling(timedelta(0))).agg(_n()).sink(NullSink()),
        pipe.window(WindowPolicy.sliding(day, 2 * day)).agg(_n()).sink(NullSink()),
        pipe.on_error(ErrorPolicy.DEAD_LETTER).try_map("k", F.col("r_name")).sink(NullSink()),
    ]
    found = []
    for k, pipeline in enumerate(wrong):
        try:
            pipeline.run()
        except ConfigError as e:
            found.append((k, e.kind.name, e.stage))
    return spark.createDataFrame(found, "step long, kind string, stage string")


def _slices(spark, d, parts: int = 4) -> list[DataFrame]:
    """Events as the micro-batches that a stream of them would bring."""
    rows = _table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    if low is None:
        return []
    edge = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
    return [rows.filter((F.col("event_id") >= a) & (F.col("event_id") < b)) for a, b in zip(edge, edge[1:])]


def _streamed(spark, d, spec, keys=()) -> DataFrame:
    """The windows that four micro-batches and the end of the stream close."""
    out, state = _folder(spark), _folder(spark)
    schema = _table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value").schema
    windows = StreamWindows(spark, state, schema, ["event_id"], "ts", spec, list(keys), (_n(), F.sum(_cents()).alias("cents")), lambda df, no: df.write.mode("append").parquet(out))
    for no, part in enumerate(_slices(spark, d)):
        windows(part, no)
    windows.finish()
    return spark.read.parquet(out).select(*keys, "window_start", "window_end", "n", "cents")


def stream_tumbling(spark, d):
    return _streamed(spark, d, whole(WindowPolicy.tumbling(timedelta(hours=1))))


def stream_tumbling_keyed(spark, d):
    return _streamed(spark, d, whole(WindowPolicy.tumbling(timedelta(hours=6))), ["event_type"])


def stream_session_keyed(spark, d):
    return _streamed(spark, d, whole(WindowPolicy.session(timedelta(hours=6))), ["user_id"])


def stream_max_keys(spark, d):
    """At most 20 users have open windows; the least recent one is put out, over micro-batches as over the table."""
    return _streamed(spark, d, whole(WindowPolicy.tumbling(timedelta(days=1))).max_keys(20), ["user_id"])


def stream_batches(spark, d):
    """Batches by count and age over four micro-batches: those of the table."""
    out, state = _folder(spark), _folder(spark)
    schema = _table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value").schema
    policy = BatchPolicy().max_items(10).max_age(timedelta(hours=1))
    batches = StreamBatches(spark, state, schema, ["event_id"], policy, clock="ts", aggregates=(_n(), F.min("event_id").alias("first"), F.sum(_cents()).alias("cents")), emit=lambda df, no: df.write.mode("append").parquet(out))
    for no, part in enumerate(_slices(spark, d)):
        batches(part, no)
    batches.finish()
    return spark.read.parquet(out).select("batch_id", "n", "first", "cents")


class _Visits(Stage):
    """Per key: each row with the number and the sum so far, and a last row for the whole stream."""

    def __init__(self):
        self.n = self.cents = 0

    def process(self, row):
        self.n, self.cents = self.n + 1, self.cents + math.floor(row["value"] * 100)
        yield {"event_id": row["event_id"], "n": self.n, "cents": self.cents}

    def flush(self):
        yield {"event_id": None, "n": self.n, "cents": self.cents}


def stream_stage(spark, d):
    """A custom stage for each user over four micro-batches, begun anew from its state before each."""
    out, state = _folder(spark), _folder(spark)
    schema = _table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value").schema

    def stage():
        return StreamStage(spark, state, schema, ["event_id"], _Visits(), "event_id long, n long, cents long", ["user_id"], lambda df, no: df.write.mode("append").parquet(out))

    for no, part in enumerate(_slices(spark, d)):
        stage()(part, no)
    stage().finish()
    return spark.read.parquet(out).select("user_id", "event_id", "n", "cents")


def stream_steps(spark, d):
    """Three files: a step takes the first, and ``finish`` the rest."""
    path, out, checkpoint = _folder(spark), _folder(spark), _folder(spark)
    rows = _table(spark, d, "supplier").select("s_suppkey")
    for k in range(3):
        rows.filter(F.col("s_suppkey") % 3 == k).coalesce(1).write.mode("append").parquet(path)
    took = {"by": "step"}
    runner = StepRunner(spark, path, rows.schema, checkpoint, lambda df, no: df.withColumn("taken_by", F.lit(took["by"])).write.mode("append").parquet(out))
    if runner.step() is Step.ITEM:
        took["by"] = "finish"
        runner.finish()
    return settled(spark.read.parquet(out).select("s_suppkey", "taken_by"))


QUERIES = {f.__name__: f for f in (iter_source, from_iter, channel_source, fn_source, chain_source, byte_lines, line_overflow_skip, line_overflow_error, utf8_lossy, tee_sink, writer_sink, vec_sink, fn_sink, channel_sink, fail_fast, dead_letter_sink, run_drivers, events_observed, config_errors, stream_tumbling, stream_tumbling_keyed, stream_session_keyed, stream_max_keys, stream_batches, stream_stage, stream_steps)}

_VALUES = "(VALUES (CAST(0 AS BIGINT), 'alpha', CAST(3 AS BIGINT)), (1, 'beta', 1), (2, 'gamma', 2)) v(seq, word, n)"
_LINE = "doc_id || coalesce(chr(9) || regexp_replace(text, '[\\r\\n]', ' ', 'g'), '')"
_NATIONS = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_no, n_name AS name FROM nation"

ORACLE_SQL = {
    "iter_source": f"SELECT * FROM {_VALUES} WHERE n > 1",
    "from_iter": f"SELECT seq, word, n * 10 AS n FROM {_VALUES}",
    "channel_source": f"SELECT * FROM {_VALUES}",
    "fn_source": "SELECT k AS seq, k, k * k AS square FROM range(10000) r(k) WHERE k * k % 3 = 1",
    "chain_source": "SELECT CAST(0 AS BIGINT) AS source_no, row_number() OVER (ORDER BY n_nationkey) - 1 AS seq, n_name AS name FROM nation UNION ALL SELECT 1, row_number() OVER (ORDER BY r_regionkey) - 1, r_name FROM region",
    "byte_lines": f"SELECT doc_id, CAST(least(strlen({_LINE}), {LIMIT}) AS BIGINT) AS bytes FROM documents",
    "line_overflow_skip": f"SELECT doc_id, CAST(strlen({_LINE}) AS BIGINT) AS bytes FROM documents WHERE strlen({_LINE}) <= {10 * LIMIT}",
    "line_overflow_error": "SELECT 'LineTooLong' AS error, min(r) AS line FROM (SELECT r_regionkey + 1 AS size, row_number() OVER (ORDER BY r_regionkey) AS r FROM region) WHERE size > 3 HAVING count(*) > 0",
    "utf8_lossy": "SELECT event_id, event_type || chr(65533) AS word FROM events",
    "tee_sink": "SELECT copy, event_id, CAST(floor(value * 100) AS BIGINT) AS cents FROM events, (VALUES (CAST(0 AS BIGINT)), (1)) v(copy)",
    "writer_sink": "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_no, o_custkey || ' ' || o_orderkey AS line FROM orders",
    "vec_sink": _NATIONS,
    "fn_sink": "SELECT CAST(n_nationkey AS BIGINT) AS key, CAST(sum(n_regionkey) OVER (ORDER BY n_nationkey) AS BIGINT) AS total FROM nation",
    "channel_sink": _NATIONS,
    "fail_fast": f"WITH e AS (SELECT event_id, {_K} AS k FROM events) SELECT event_id, k FROM e WHERE event_id < coalesce((SELECT min(event_id) FROM e WHERE k IS NULL), event_id + 1)",
    "dead_letter_sink": f"SELECT user_id, CASE WHEN {_K} IS NULL THEN 'lost' ELSE 'kept' END AS fate, count(*) AS n FROM events GROUP BY ALL",
    "run_drivers": "SELECT way, count(*) AS items_in, count(*) FILTER (WHERE value > 50) AS items_out FROM events, (VALUES ('run'), ('run_threaded'), ('run_with')) v(way) GROUP BY way",
    "events_observed": f"""WITH c AS (SELECT count(*) - count({_K}) AS bad FROM events)
        SELECT CAST(0 AS BIGINT) AS step, 'started' AS kind, NULL AS stage, CAST(0 AS BIGINT) AS n UNION ALL SELECT 1, 'stage_error', 'parse', bad FROM c
        UNION ALL SELECT 2, 'dead_lettered', NULL, bad FROM c UNION ALL SELECT 3, 'finished', NULL, 0""",
    "config_errors": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'NO_BATCH_TRIGGER', 'here'), (1, 'ZERO_LIMIT', 'here'), (2, 'BYTES_REQUIRE_BYTE_SIZE', 'here'), (3, 'ZERO_DURATION', 'here'), (4, 'SLIDE_EXCEEDS_SIZE', 'here'), (5, 'DEAD_LETTER_SINK_MISSING', 'here')) v(step, kind, stage)",
    "stream_tumbling": _tumbling("1 HOUR"),
    "stream_tumbling_keyed": _tumbling("6 HOUR", "event_type,"),
    "stream_session_keyed": _session("6 HOUR", "user_id,"),
    "stream_max_keys": f"""WITH a AS (SELECT event_id, user_id, ts, value, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
        d AS (SELECT a.event_id, count(DISTINCT b.user_id) AS others FROM a JOIN events b ON b.event_id > a.prev AND b.event_id < a.event_id GROUP BY a.event_id),
        c AS (SELECT a.*, sum(CASE WHEN coalesce(d.others, 0) >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a.event_id) AS lru FROM a LEFT JOIN d USING (event_id)),
        w AS (SELECT user_id, lru, time_bucket(INTERVAL 1 DAY, ts, {_T0}) AS window_start, count(*) AS n, {_C} FROM c GROUP BY ALL)
        SELECT user_id, window_start, window_start + INTERVAL 1 DAY AS window_end, n, cents FROM w""",
    "stream_batches": _greedy("", "events", "CAST(floor(value * 100) AS BIGINT)", "(w.c >= 10 OR w.t - w.opened >= 3600000000)", "event_id", "epoch_us(ts)", "min(id) AS first, CAST(sum(size) AS BIGINT) AS cents"),
    "stream_stage": """WITH e AS (SELECT event_id, user_id, CAST(floor(value * 100) AS BIGINT) AS c FROM events)
        SELECT user_id, event_id, row_number() OVER w AS n, CAST(sum(c) OVER w AS BIGINT) AS cents FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
        UNION ALL SELECT user_id, NULL, count(*), CAST(sum(c) AS BIGINT) FROM e GROUP BY user_id""",
    "stream_steps": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'step' ELSE 'finish' END AS taken_by FROM supplier",
}
