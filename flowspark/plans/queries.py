"""One query for each operator of the engine, over the driver's tables, with its SQL twin."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..operators.grouping import numbered
from ..operators.stages import Stage
from ..policies import BatchPolicy, ErrorPolicy, RetryPolicy, WindowPolicy, WindowSpec
from ..sinks import NullSink
from .pipe import Pipe

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
def _n():
    return F.count(F.lit(1)).alias("n")



def _cents():
    return F.floor(F.col("value") * 100).cast("long")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> Pipe:
    return Pipe.from_df(_table(spark, sf_dir, "events"), "event_id", "ts")


def map_filter(spark, d):
    pipe = Pipe.from_df(_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    pipe = pipe.filter("l_quantity > 25 and l_returnflag = 'R'")
    return pipe.map("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") * 100).cast("long").alias("cents")).df


def filter_map_parse(spark, d):
    pipe = _events(spark, d).filter_map("k", F.expr("try_cast(get_json_object(props, '$.k') as int)"))
    return pipe.df.select("event_id", "k")


def flat_map_words(spark, d):
    pipe = Pipe.from_df(_table(spark, d, "documents"), "doc_id").flat_map("word", F.split("text", " "))
    return pipe.df.groupBy("word").agg(_n())


def inspect_observe(spark, d):
    pipe, seen = _events(spark, d).inspect("seen", _n(), F.sum(_cents()).alias("cents"))
    pipe.sink(NullSink()).run()
    got = seen.get
    return spark.createDataFrame([(got["n"], got["cents"])], "n long, cents long")


def chain_sources(spark, d):
    def part(name, key):
        return Pipe.from_df(_table(spark, d, name).select(F.col(key).alias("key")), "key")

    chained = part("supplier", "s_suppkey").chain(part("customer", "c_custkey"))
    return numbered(chained.df.withColumnRenamed("_src", "src"), ["src", "key"]).select("row_no", "src", "key")


def etl_enrich(spark, d):
    names = _table(spark, d, "nation").filter("n_regionkey <> 0").select("n_nationkey", "n_name")
    pipe = Pipe.from_df(_table(spark, d, "customer"), "c_custkey")
    rows = pipe.df.join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


def _parsed(spark, d, policy, ref=True):
    pipe = _events(spark, d).on_error(policy).stage_id("parse")
    number = F.expr("case when user_id % 7 = 0 then null else try_cast(get_json_object(props, '$.k') as int) end")
    return (pipe.try_map_ref if ref else pipe.try_map)("k", number, "no number")


def try_map_continue(spark, d):
    return _parsed(spark, d, ErrorPolicy.CONTINUE).df.select("event_id", "k")


def try_map_dead_letter(spark, d):
    return _parsed(spark, d, ErrorPolicy.DEAD_LETTER).dead_letters.select("stage", "error", F.get_json_object("input", "$.user_id").cast("long").alias("user_id"), "attempts")


def dead_letter_counts(spark, d):
    pipe = _parsed(spark, d, ErrorPolicy.DEAD_LETTER, ref=False)
    return pipe.dead_letters.groupBy("stage", "error").agg(_n(), F.count("input").alias("with_input"))


def retry_attempts(spark, d):
    calls: dict = {}

    def work(row):
        k = row["event_id"]
        calls[k] = calls.get(k, 0) + 1
        if calls[k] <= k % 4:
            raise ValueError("not yet")
        return {"value_of": k * 2}

    pipe = _events(spark, d).map("user_id").on_error(ErrorPolicy.DEAD_LETTER).try_map_retry(RetryPolicy(3), work, "value_of long")
    return pipe.fallible[0].rows.select("event_id", "value_of", F.col("_tries").alias("attempts"), F.col("_err").alias("error"))


class _Running(Stage):
    def __init__(self):
        self.total = 0

    def process(self, row):
        self.total += row["cents"]
        yield {"event_id": row["event_id"], "total": self.total}

    def flush(self):
        yield {"event_id": -1, "total": self.total}


def custom_stage(spark, d):
    pipe = _events(spark, d).map("event_id", _cents().alias("cents"))
    return pipe.stage(_Running(), "event_id long, total long").df


def running_total(spark, d):
    from ..operators.grouping import running_sum

    rows = _table(spark, d, "events").select("event_id", _cents().alias("cents"))
    return running_sum(rows, ["event_id"], "cents", "total").select("event_id", "total")


def batch_count(spark, d):
    pipe = Pipe.from_df(_table(spark, d, "orders"), "o_orderkey")
    return pipe.batch(BatchPolicy().max_items(100)).agg(_n(), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")).df.drop("first_at")


def batch_bytes(spark, d):
    pipe = Pipe.from_df(_table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return pipe.batch_bytes(BatchPolicy().max_bytes(16_384), size).agg(_n(), F.sum(size).cast("long").alias("bytes"), F.min("doc_id").alias("first")).df.drop("first_at")


def batch_age(spark, d):
    return _events(spark, d).batch(BatchPolicy().max_age(HOUR)).agg(_n(), F.min("event_id").alias("first")).df.drop("first_at")


def batch_combined(spark, d):
    return _events(spark, d).batch(BatchPolicy().max_items(10).max_age(HOUR)).agg(_n(), F.min("event_id").alias("first")).df.drop("first_at")


def log_shipper(spark, d):
    """Lines parsed, filtered, put in batches of four and joined."""
    lines = _table(spark, d, "events").select("event_id", F.concat_ws(" ", F.upper("event_type"), "props").alias("line"))
    pipe = Pipe.from_df(lines, "event_id").map(F.split("line", " ", 2)[0].alias("level"), F.split("line", " ", 2)[1].alias("body"))
    pipe = pipe.filter("level <> 'VIEW'").map(F.concat(F.lit("["), "level", F.lit("] "), "body").alias("text"))
    blobs = pipe.batch(BatchPolicy().max_items(4)).items("text").df
    return blobs.select("batch_id", "n", F.array_join("items.text", "\n").alias("blob"))


def whole(spec) -> WindowSpec:
    """``spec`` without the default caps on items and keys, as the SQL has none."""
    return WindowSpec.of(spec).max_items(None).max_keys(None)


def _window(pipe, spec, keys=(), clock=None):
    """Windows with the caps of ``spec``, where it has any."""
    return pipe.window_by_key(list(keys), spec if isinstance(spec, WindowSpec) else whole(spec), clock)


def _sums(grouped, *keys):
    return grouped.agg(_n(), F.sum(_cents()).alias("cents")).df.select(*keys, "window_start", "window_end", "n", "cents")


def window_tumbling(spark, d):
    return _sums(_window(_events(spark, d), WindowPolicy.tumbling(HOUR)))


def window_tumbling_keyed(spark, d):
    return _sums(_window(_events(spark, d), WindowPolicy.tumbling(HOUR), ["user_id"]), "user_id")


def window_sliding(spark, d):
    return _sums(_window(_events(spark, d), WindowPolicy.sliding(10 * HOUR, 4 * HOUR)))


def window_sliding_keyed(spark, d):
    return _sums(_window(_events(spark, d), WindowPolicy.sliding(DAY, 8 * HOUR), ["event_type"]), "event_type")


def window_session(spark, d):
    return _sums(_window(_events(spark, d), WindowPolicy.session(timedelta(minutes=5))))


def window_session_keyed(spark, d):
    return _sums(_window(_events(spark, d), WindowPolicy.session(6 * HOUR), ["user_id"]), "user_id")


def window_max_items(spark, d):
    return _window(_events(spark, d), whole(WindowPolicy.tumbling(DAY)).max_items(50)).agg(_n(), F.min("event_id").alias("first")).df.select("window_start", "chunk", "n", "first")


def window_max_keys(spark, d):
    grouped = _window(_events(spark, d), whole(WindowPolicy.tumbling(DAY)).max_keys(20), ["user_id"])
    return grouped.agg(_n(), F.min("event_id").alias("first")).df.select("user_id", "window_start", "lru", "n", "first")


def window_late_clamp(spark, d):
    late = _table(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 10 == 3, F.col("ts") - F.expr("interval 3 hours")).otherwise(F.col("ts")))
    return _sums(_window(Pipe.from_df(late, "event_id", "ts"), WindowPolicy.tumbling(HOUR)))


def window_items(spark, d):
    """Windows that carry their items, digested."""
    out = _window(_events(spark, d), WindowPolicy.tumbling(6 * HOUR), ["event_type"]).items("event_id").df
    return out.select("event_type", "window_start", "n", F.md5(F.array_join(F.transform("items.event_id", lambda x: x.cast("string")), ",")).alias("digest"))


def buffer_noop(spark, d):
    return _events(spark, d).buffer(64).filter("value > 50").buffer(0).df.select("event_id", _cents().alias("cents"))


def run_stats(spark, d):
    pipe = _parsed(spark, d, ErrorPolicy.DEAD_LETTER).dead_letter(NullSink())
    s = pipe.batch(BatchPolicy().max_items(1_000)).agg(_n()).sink(NullSink()).run()
    return spark.createDataFrame([(s.items_in, s.items_out, s.errors, s.dead_lettered, s.retries)], "items_in long, items_out long, errors long, dead_lettered long, retries long")


def reader_lines(spark, d):
    """Documents written as lines of text and read again."""
    from ..sources import ReaderSource

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    _table(spark, d, "conversations").select(F.concat_ws("\t", "conv_id", "turn", F.regexp_replace("text", "[\r\n]", " ")).alias("value")).write.text(path)
    pipe = Pipe.from_source(ReaderSource(path), spark)
    parts = F.split("line", "\t", 3)
    return pipe.df.select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), F.char_length(parts[2]).cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (map_filter, filter_map_parse, flat_map_words, inspect_observe, chain_sources, etl_enrich, try_map_continue, try_map_dead_letter, dead_letter_counts, retry_attempts, custom_stage, running_total, batch_count, batch_bytes, batch_age, batch_combined, log_shipper, window_tumbling, window_tumbling_keyed, window_sliding, window_sliding_keyed, window_session, window_session_keyed, window_max_items, window_max_keys, window_late_clamp, window_items, buffer_noop, run_stats, reader_lines)}

_K = "CASE WHEN user_id % 7 = 0 THEN NULL ELSE try_cast(json_extract_string(props, '$.k') AS INTEGER) END"
_C = "CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents"
_T0 = "(SELECT arg_min(ts, event_id) FROM events)"


def _tumbling(iv: str, keys: str = "", table: str = "events", ts: str = "ts") -> str:
    return f"SELECT {keys} time_bucket(INTERVAL {iv}, {ts}, {_T0}) AS window_start, time_bucket(INTERVAL {iv}, {ts}, {_T0}) + INTERVAL {iv} AS window_end, count(*) AS n, {_C} FROM {table} GROUP BY ALL"


def _sliding(size: int, step: int, keys: str = "") -> str:
    """``size`` and ``step`` in hours."""
    return f"""WITH e AS (SELECT *, epoch_us(ts) - epoch_us({_T0}) AS el FROM events),
        w AS (SELECT *, unnest(range(CAST(floor(el / {step * 3_600_000_000.0}) AS BIGINT) - {-(-size // step)}, CAST(floor(el / {step * 3_600_000_000.0}) AS BIGINT) + 1)) AS k FROM e)
        SELECT {keys} {_T0} + to_microseconds(k * {step * 3_600_000_000}) AS window_start, {_T0} + to_microseconds(k * {step * 3_600_000_000} + {size * 3_600_000_000}) AS window_end, count(*) AS n, {_C}
        FROM w WHERE el - k * {step * 3_600_000_000} >= 0 AND el - k * {step * 3_600_000_000} < {size * 3_600_000_000} GROUP BY ALL"""


def _session(idle: str, keys: str = "") -> str:
    by = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    return f"""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({by} ORDER BY event_id) > INTERVAL {idle} THEN 1 ELSE 0 END AS new FROM events),
        b AS (SELECT *, sum(new) OVER ({by} ORDER BY event_id) AS s FROM a)
        SELECT {keys} min(ts) AS window_start, max(ts) AS window_end, count(*) AS n, {_C} FROM b GROUP BY {keys} s"""


def _greedy(fields: str, source: str, size: str, close: str, key: str, ts: str, out: str) -> str:
    """Batches by a recursive walk: an item goes in first, then the limits are looked at."""
    return f"""WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY {key}) AS r, {key} AS id, {size} AS size, {ts} AS t FROM {source}),
        w AS (SELECT r, id, size, t, CAST(0 AS BIGINT) AS batch_id, CAST(1 AS BIGINT) AS c, size AS total, t AS opened FROM x WHERE r = 1
            UNION ALL
            SELECT x.r, x.id, x.size, x.t, CASE WHEN {close} THEN w.batch_id + 1 ELSE w.batch_id END, CASE WHEN {close} THEN 1 ELSE w.c + 1 END,
                CASE WHEN {close} THEN x.size ELSE w.total + x.size END, CASE WHEN {close} THEN x.t ELSE w.opened END
            FROM w JOIN x ON x.r = w.r + 1)
        SELECT batch_id, count(*) AS n, {out} FROM w GROUP BY batch_id"""


ORACLE_SQL = {
    "map_filter": "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'",
    "filter_map_parse": "SELECT * FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k IS NOT NULL",
    "flat_map_words": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word",
    "inspect_observe": f"SELECT count(*) AS n, {_C} FROM events",
    "chain_sources": "SELECT row_number() OVER (ORDER BY src, key) - 1 AS row_no, src, key FROM (SELECT 0 AS src, s_suppkey AS key FROM supplier UNION ALL SELECT 1, c_custkey FROM customer)",
    "etl_enrich": "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON c_nationkey = n_nationkey",
    "try_map_continue": f"SELECT * FROM (SELECT event_id, {_K} AS k FROM events) WHERE k IS NOT NULL",
    "try_map_dead_letter": f"SELECT 'parse' AS stage, 'no number' AS error, user_id, 1 AS attempts FROM events WHERE {_K} IS NULL",
    "dead_letter_counts": f"SELECT 'parse' AS stage, 'no number' AS error, count(*) AS n, CAST(0 AS BIGINT) AS with_input FROM events WHERE {_K} IS NULL HAVING count(*) > 0",
    "retry_attempts": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id * 2 END AS value_of, CAST(least(event_id % 4 + 1, 3) AS INTEGER) AS attempts, CASE WHEN event_id % 4 >= 3 THEN 'not yet' END AS error FROM events",
    "custom_stage": "WITH e AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS c FROM events) SELECT row_number() OVER (ORDER BY event_id) - 1 AS out_no, event_id, CAST(sum(c) OVER (ORDER BY event_id) AS BIGINT) AS total FROM e UNION ALL SELECT count(*), -1, CAST(sum(c) AS BIGINT) FROM e",
    "running_total": "SELECT event_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (ORDER BY event_id) AS BIGINT) AS total FROM events",
    "batch_count": "SELECT (r - 1) // 100 AS batch_id, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1",
    "batch_bytes": _greedy("", "documents", "CAST(strlen(coalesce(text, '')) AS BIGINT)", "w.total >= 16384", "doc_id", "0", "CAST(sum(size) AS BIGINT) AS bytes, min(id) AS first"),
    "batch_age": _greedy("", "events", "CAST(0 AS BIGINT)", "w.t - w.opened >= 3600000000", "event_id", "epoch_us(ts)", "min(id) AS first"),
    "batch_combined": _greedy("", "events", "CAST(0 AS BIGINT)", "(w.c >= 10 OR w.t - w.opened >= 3600000000)", "event_id", "epoch_us(ts)", "min(id) AS first"),
    "log_shipper": "WITH p AS (SELECT event_id, '[' || upper(event_type) || '] ' || props AS text, row_number() OVER (ORDER BY event_id) AS r FROM events WHERE upper(event_type) <> 'VIEW') SELECT (r - 1) // 4 AS batch_id, count(*) AS n, string_agg(text, chr(10) ORDER BY event_id) AS blob FROM p GROUP BY 1",
    "window_tumbling": _tumbling("1 HOUR"),
    "window_tumbling_keyed": _tumbling("1 HOUR", "user_id,"),
    "window_sliding": _sliding(10, 4),
    "window_sliding_keyed": _sliding(24, 8, "event_type,"),
    "window_session": _session("5 MINUTE"),
    "window_session_keyed": _session("6 HOUR", "user_id,"),
    "window_max_items": f"WITH a AS (SELECT event_id, time_bucket(INTERVAL 1 DAY, ts, {_T0}) AS window_start FROM events), b AS (SELECT *, (row_number() OVER (PARTITION BY window_start ORDER BY event_id) - 1) // 50 AS chunk FROM a) SELECT window_start, chunk, count(*) AS n, min(event_id) AS first FROM b GROUP BY ALL",
    "window_max_keys": f"""WITH a AS (SELECT event_id, user_id, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
        d AS (SELECT a.event_id, count(DISTINCT b.user_id) AS others FROM a JOIN events b ON b.event_id > a.prev AND b.event_id < a.event_id GROUP BY a.event_id),
        c AS (SELECT a.*, CAST(sum(CASE WHEN coalesce(d.others, 0) >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a.event_id) AS BIGINT) AS lru FROM a LEFT JOIN d USING (event_id))
        SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, {_T0}) AS window_start, lru, count(*) AS n, min(event_id) AS first FROM c GROUP BY ALL""",
    "window_late_clamp": _tumbling("1 HOUR", "", "(SELECT event_id, value, max(CASE WHEN event_id % 10 = 3 THEN ts - INTERVAL 3 HOUR ELSE ts END) OVER (ORDER BY event_id) AS moment FROM events)", "moment"),
    "window_items": f"SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, {_T0}) AS window_start, count(*) AS n, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS digest FROM events GROUP BY ALL",
    "buffer_noop": "SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS cents FROM events WHERE value > 50",
    "run_stats": f"SELECT count(*) AS items_in, CAST(ceil(count({_K}) / 1000.0) AS BIGINT) AS items_out, count(*) - count({_K}) AS errors, count(*) - count({_K}) AS dead_lettered, CAST(0 AS BIGINT) AS retries FROM events",
    "reader_lines": "SELECT conv_id, turn, length(regexp_replace(text, '[\\r\\n]', ' ', 'g')) AS chars FROM conversations",
}
