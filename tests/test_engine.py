"""The engine against plain sequential models and rules worked out by hand; inputs are drawn or made here."""

import os
import queue
import random
import subprocess
import sys
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark import Backoff, BatchPolicy, Cancelled, Closed, ConfigError, ErrorPolicy, InvalidUtf8, LineOverflow, LineTooLong, RetryPolicy, SinkError, StageError, WindowPolicy, WindowSpec
from flowspark import ConfigErrorKind as Kind
from flowspark.operators import grouping
from flowspark.operators.stages import Stage
from flowspark.plans.pipe import Pipe, SyncDriver, letters
from flowspark.sinks import ChannelSink, FnSink, NullSink, Sink, TeeSink, VecSink, WriterSink
from flowspark.sources import ByteLinesSource, ChainSource, ChannelSource, FnSource, IterSource, ReaderSource

T0 = datetime(2031, 5, 17, 6)
S = timedelta(seconds=1)


def ints(spark, *values):
    return Pipe.from_iter(spark, values, "n int")


def strings(spark, *values):
    return Pipe.from_iter(spark, values, "s string")


def timed(spark, *pairs):
    """(offset in seconds, item) pairs."""
    return Pipe.from_iter(spark, [(T0 + timedelta(seconds=t), n) for t, n in pairs], "ts timestamp_ntz, n int", "ts")


def collect(pipe, column):
    sink = VecSink()
    stats = pipe.sink(sink).run()
    return [r[column] for r in sink.handle().take()], stats


def parse(pipe, policy, ref=False):
    pipe = pipe.on_error(policy).stage_id("parse")
    return (pipe.try_map_ref if ref else pipe.try_map)("n", F.expr("try_cast(s as int)"), "not a number")


# -- records ------------------------------------------------------------------


def test_map_and_filter(spark):
    xs = list(range(-7, 30, 3))
    got, stats = collect(ints(spark, *xs).map((F.col("n") * 4 + 1).alias("n")).filter("n % 3 <> 0"), "n")
    assert got == [4 * x + 1 for x in xs if (4 * x + 1) % 3] and (stats.items_in, stats.items_out) == (len(xs), len(got))


def test_python_functions(spark):
    pipe = ints(spark, *range(9)).map(fn=lambda r: {"m": r["n"] ** 2}, schema="m int").filter(lambda r: r["m"] % 2 == 1)
    assert collect(pipe, "m")[0] == [x * x for x in range(9) if x % 2]


def test_filter_map(spark):
    words = ["77", "seven", "-4", "", "4e", "0012"]
    assert collect(strings(spark, *words).filter_map("n", F.expr("try_cast(s as int)")), "n")[0] == [77, -4, 12]


def test_flat_map(spark):
    texts = ["red,green", "", "blue", "x,,y"]
    got, stats = collect(strings(spark, *texts).flat_map("w", F.filter(F.split("s", ","), lambda w: w != "")), "w")
    assert got == [w for t in texts for w in t.split(",") if w] and (stats.items_in, stats.items_out) == (4, 5)


def test_inspect(spark):
    pipe, seen = ints(spark, 9, 8, 13).inspect("most", F.max("n").alias("most"), F.count(F.lit(1)).alias("k"))
    assert collect(pipe, "n")[0] == [9, 8, 13] and (seen.get["most"], seen.get["k"]) == (13, 3)


def test_chain_and_tee(spark):
    a, b = VecSink(), VecSink()
    stats = ints(spark, 40, 5).chain(ints(spark, 7, 6, 5)).sink(TeeSink(a, b)).run()
    assert [r.n for r in a.handle().take()] == [r.n for r in b.handle().snapshot()] == [40, 5, 7, 6, 5] and stats.items_out == 5
    pipe = Pipe.from_source(ChainSource(IterSource([(8,)], "n int"), IterSource([(3,), (9,)], "n int")), spark)
    assert collect(pipe, "n")[0] == [8, 3, 9]


class Longest(Stage):
    """Passes on each row that is longer than all before; ends with their number; a star is an error."""

    def __init__(self):
        self.most = self.kept = 0

    def process(self, row):
        if "*" in row["s"]:
            raise ValueError(f"star in {row['s']}")
        if len(row["s"]) > self.most:
            self.most, self.kept = len(row["s"]), self.kept + 1
            yield {"s": row["s"]}

    def flush(self):
        yield {"s": str(self.kept)}


def test_stage(spark):
    assert collect(strings(spark, "bb", "a", "cccc", "ddd", "eeeeee").stage(Longest(), "s string"), "s")[0] == ["bb", "cccc", "eeeeee", "3"]


def test_stage_errors_fall_under_the_policy(spark):
    rows = ["bb", "***", "cccc", "d*", "eeeeee"]
    got, stats = collect(strings(spark, *rows).on_error(ErrorPolicy.CONTINUE).stage(Longest(), "s string"), "s")
    assert got == ["bb", "cccc", "eeeeee", "3"] and stats.errors == 2
    dead = VecSink()
    pipe = strings(spark, *rows).on_error(ErrorPolicy.DEAD_LETTER).stage_id("longest").stage(Longest(), "s string").dead_letter(dead)
    assert collect(pipe, "s")[1].dead_lettered == 2
    assert sorted((f.stage, f.error, f.input["s"]) for f in letters(dead.handle().take())) == [("longest", "star in ***", "***"), ("longest", "star in d*", "d*")]
    out = VecSink()
    with pytest.raises(StageError, match="stage `stage`: star in"):
        strings(spark, *rows).stage(Longest(), "s string").sink(out).run()
    assert [r.s for r in out.handle().take()] == ["bb"]


def halves():
    n = 1000
    while n:
        yield {"n": n}
        n //= 2


def test_generated_source(spark):
    pipe = Pipe.from_source(FnSource(halves, "n int"), spark).filter("n % 2 = 0")
    assert collect(pipe, "n")[0] == [r["n"] for r in halves() if r["n"] % 2 == 0]


def test_channels(spark):
    q, out = queue.Queue(), queue.Queue(10)
    for x in ((31,), (30,), None):
        q.put(x)
    assert Pipe.from_source(ChannelSource(q, "n int"), spark).sink(ChannelSink(out, 5)).run().items_out == 2
    assert [out.get().n for _ in range(2)] == [31, 30]


# -- errors -------------------------------------------------------------------

MIXED = ["12", "dozen", "-3", "4 4", "900", "", "5"]
GOOD, BAD = [12, -3, 900, 5], ["", "4 4", "dozen"]


def test_queues_that_the_other_side_left(spark):
    q = queue.Queue()
    q.put((7,))
    q.shutdown()
    out = queue.Queue(3)
    pipe = Pipe.from_source(ChannelSource(q, "n int", 60), spark)
    assert pipe.df.count() == 1

    numbers = Pipe.from_iter(spark, range(10), "n int")
    leave = threading.Timer(3, out.shutdown)  # the run then waits at the fourth row
    leave.start()
    with pytest.raises(SinkError) as e:
        numbers.sink(ChannelSink(out)).run()
    assert isinstance(e.value.cause, queue.ShutDown)
    assert [out.get()["n"] for _ in range(3)] == [0, 1, 2]
    with pytest.raises(SinkError) as e:
        numbers.sink(ChannelSink(queue.Queue(3), 0.1)).run()
    assert isinstance(e.value.cause, queue.Full)


def test_dead_letters(spark):
    for ref in (False, True):
        dead, out = VecSink(), VecSink()
        stats = parse(strings(spark, *MIXED), ErrorPolicy.DEAD_LETTER, ref).dead_letter(dead).sink(out).run()
        assert [r.n for r in out.handle().take()] == GOOD
        got = letters(dead.handle().take())
        assert {(f.stage, f.attempts) for f in got} == {("parse", 1)} and len(got) == len(BAD)
        assert sorted(f.input["s"] for f in got) == BAD if ref else all(f.input is None for f in got)
        assert (stats.errors, stats.dead_lettered, stats.items_out) == (3, 3, 4)


def test_dead_letter_without_sink(spark):
    pipeline = parse(strings(spark, *MIXED), ErrorPolicy.DEAD_LETTER).sink(NullSink())
    assert pipeline.config_error == ConfigError(Kind.DEAD_LETTER_SINK_MISSING, "parse")
    with pytest.raises(ConfigError):
        pipeline.run()
    with pytest.raises(ConfigError):
        parse(strings(spark, *MIXED), ErrorPolicy.DEAD_LETTER).try_sink(NullSink())


def test_policies_mix(spark):
    pipe = parse(strings(spark, *MIXED), ErrorPolicy.CONTINUE).on_error(ErrorPolicy.FAIL_FAST).try_map("n", F.col("n"), "too small", F.col("n") < -10)
    got, stats = collect(pipe, "n")
    assert got == GOOD and stats.errors == 3


def test_fail_fast_keeps_what_came_before(spark):
    out = VecSink()
    pipeline = parse(strings(spark, "6", "28", "perfect", "496"), ErrorPolicy.FAIL_FAST).sink(out)
    with pytest.raises(StageError, match="stage `parse`: not a number"):
        pipeline.run()
    assert [r.n for r in out.handle().take()] == [6, 28]
    with pytest.raises(Closed):
        pipeline.run()


def test_retry(spark):
    calls: dict = {}

    def later(row):
        calls[row["n"]] = calls.get(row["n"], 0) + 1
        if calls[row["n"]] <= row["n"]:
            raise ValueError("not yet")
        return {"m": -row["n"]}

    got, stats = collect(ints(spark, 0, 3, 1).try_map_retry(RetryPolicy(4).backoff(Backoff.fixed(timedelta(milliseconds=2))), later, "m int"), "m")
    assert got == [0, -3, -1] and (stats.retries, stats.errors) == (4, 0)


def test_retry_gives_up(spark):
    def odd(row):
        if row["n"] % 2:
            raise KeyError("odd")
        return {"m": row["n"]}

    dead = VecSink()
    stats = ints(spark, 4, 7, 6).on_error(ErrorPolicy.DEAD_LETTER).try_map_retry(RetryPolicy(5), odd, "m int").dead_letter(dead).sink(NullSink()).run()
    (letter,) = letters(dead.handle().take())
    assert (stats.retries, stats.errors, stats.dead_lettered, letter.attempts, letter.input, letter.error_type) == (4, 1, 1, 5, {"n": 7}, "KeyError")
    with pytest.raises(StageError, match="stage `try_map_retry`: 'odd'"):
        ints(spark, 1).try_map_retry(RetryPolicy(2), odd, "m int").sink(NullSink()).run()


def test_backoff():
    ms = timedelta(milliseconds=1)
    p = RetryPolicy(9).backoff(Backoff.exponential(3 * ms, 40 * ms))
    assert [p.base_delay(k) / ms for k in range(1, 7)] == [min(3 * 2**k, 40) for k in range(6)] and p.base_delay(70) == 40 * ms
    assert all(timedelta(0) <= p.jitter(True).delay(3) <= p.base_delay(3) for _ in range(20))


# -- batches ------------------------------------------------------------------


def batches(pipe, column):
    return [[x[column] for x in g] for g in collect(pipe.items(column), "items")[0]]


def model_batches(rows, policy):
    """An item goes in first, then the limits are looked at."""
    out, now = [], []
    for row in rows:
        now.append(row)
        if len(now) == policy.items_limit or policy.bytes_limit is not None and sum(len(r[1]) for r in now) >= policy.bytes_limit or policy.age_limit is not None and row[0] - now[0][0] >= policy.age_limit / S:
            out.append([r[2] for r in now])
            now = []
    return out + [[r[2] for r in now]] * bool(now)


@pytest.mark.parametrize("policy", [BatchPolicy().max_items(7), BatchPolicy().max_bytes(19), BatchPolicy().max_age(6 * S), BatchPolicy().max_items(5).max_bytes(30), BatchPolicy().max_bytes(25).max_age(9 * S), BatchPolicy().max_items(4).max_bytes(40).max_age(8 * S)])
def test_batches_equal_a_sequential_model(spark, policy):
    rng = random.Random(str(policy))
    t, rows = 0, []
    for n in range(400):
        t += rng.choice([0, 0, 1, 2, 7, -3])
        rows.append((t, "z" * rng.choice([0, 1, 4, 9, 26]), n))
    pipe = Pipe.from_iter(spark, [(T0 + x * S, s, n) for x, s, n in rows], "ts timestamp_ntz, s string, n int", "ts")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 90)
    try:
        got = batches(pipe.batch(policy) if policy.bytes_limit is None else pipe.batch_bytes(policy, F.octet_length("s")), "n")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == model_batches(rows, policy)


# -- windows ------------------------------------------------------------------


class Model:
    """Windows with caps, item by item: tumbling, sliding and session."""

    def __init__(self, kind, size, most=None, keys=None, step=None):
        self.kind, self.size, self.most, self.keys, self.step = kind, size, most, keys, step or size
        self.now = self.anchor = None
        self.open, self.out = {}, []  # key: {start: items}, least recent first

    def shut(self, k, start):
        got = self.open[k].pop(start)
        if got["items"]:
            self.out.append((k, got["start"], got["last"] if self.kind == "session" else start + self.size, tuple(got["items"])))
        if not self.open[k]:
            del self.open[k]

    def feed(self, t, k, n):
        self.now = t if self.now is None else max(self.now, t)
        t, self.anchor = self.now, self.now if self.anchor is None else self.anchor
        for x in list(self.open):
            for start, w in list(self.open[x].items()):
                if (t - w["last"] > self.size) if self.kind == "session" else t >= start + self.size:
                    self.shut(x, start)
        if k not in self.open and self.keys and len(self.open) >= self.keys:
            first = next(iter(self.open))
            for start in list(self.open[first]):
                self.shut(first, start)
        mine = self.open.pop(k, {})
        self.open[k] = mine
        if self.kind == "session":
            starts = [0]
        else:
            last = self.anchor + (t - self.anchor) // self.step * self.step
            starts = [x for x in range(last, last - self.size, -self.step) if x + self.size > t]
        for start in starts:
            w = mine.setdefault(start, {"items": [], "start": t if self.kind == "session" else start, "last": t})
            w["items"].append(n)
            w["last"] = t
            if len(w["items"]) == self.most:
                self.out.append((k, w["start"], t if self.kind == "session" else start + self.size, tuple(w["items"])))
                w["items"], w["start"] = [], t if self.kind == "session" else start

    def done(self):
        for k in list(self.open):
            for start in list(self.open[k]):
                self.shut(k, start)
        return sorted(self.out)


CASES = [
    ("tumbling", dict(size=7), False), ("tumbling", dict(size=4, most=3), True), ("tumbling", dict(size=9, keys=2), True), ("tumbling", dict(size=11, most=2, keys=3), True),
    ("sliding", dict(size=9, step=4), False), ("sliding", dict(size=8, step=3, most=2), True), ("sliding", dict(size=6, step=5, keys=3), True),
    ("session", dict(size=3), False), ("session", dict(size=5, most=4), True), ("session", dict(size=4, most=2, keys=3), True),
]


def policy_of(kind, size, most=None, keys=None, step=None):
    policy = {"tumbling": WindowPolicy.tumbling, "session": WindowPolicy.session}.get(kind, lambda s: WindowPolicy.sliding(s, step * S))(size * S)
    return WindowSpec(policy, most, keys)


def timeline(seed, n, clock_back):
    rng = random.Random(seed)
    t, rows = 0, []
    for k in range(n):
        t += rng.choice([0, 0, 1, 1, 2, 5, *([-3] if clock_back else []), *([13] if k % 40 == 39 else [])])
        rows.append((t, rng.randint(0, 4), k))
    return rows


@pytest.mark.parametrize("kind,options,keyed", CASES)
@pytest.mark.parametrize("clock_back", [False, True])
def test_windows_equal_a_sequential_model(spark, kind, options, keyed, clock_back):
    rows = timeline(f"{kind}{options}", 150, clock_back)
    model = Model(kind, **options)
    for t, k, n in rows:
        model.feed(t, k if keyed else 0, n)
    pipe = Pipe.from_iter(spark, [(T0 + t * S, k, n) for t, k, n in rows], "ts timestamp_ntz, k int, n int", "ts")
    got = pipe.window_by_key(["k"] if keyed else [], policy_of(kind, **options)).items("n").df.collect()
    assert sorted((r.k if keyed else 0, (r.window_start - T0) // S, (r.window_end - T0) // S, tuple(x.n for x in r["items"])) for r in got) == model.done()


def test_least_recent_keys_over_many_ranges(spark):
    """More ranges than keys in each, so that lists of recent keys are joined over several of them."""
    rng = random.Random(23)
    rows = [(k // 3, rng.randint(0, 11) if k % 50 < 25 else rng.randint(5, 6), k) for k in range(240)]
    pipe = Pipe.from_iter(spark, [(T0 + t * S, k, n) for t, k, n in rows], "ts timestamp_ntz, k int, n int", "ts")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        for keys in (2, 7):
            model = Model("tumbling", 1000, None, keys)
            for r in rows:
                model.feed(*r)
            got = pipe.window_by_key("k", WindowSpec(WindowPolicy.tumbling(1000 * S), None, keys)).items("n").df.collect()
            assert sorted((r.k, tuple(x.n for x in r["items"])) for r in got) == sorted((k, x) for k, _, _, x in model.done())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_windows_without_end(spark):
    pipe = timed(spark, (3, 1), (50, 2), (20, 3), (400, 4))
    for policy in (WindowPolicy.tumbling(timedelta.max), WindowPolicy.session(timedelta.max)):
        (r,) = pipe.window(policy).items("n").df.collect()
        assert ([x.n for x in r["items"]], (r.window_start - T0) / S, (r.window_end - T0) / S) == ([1, 2, 3, 4], 3, 400)
    assert pipe.window(WindowPolicy.sliding(timedelta.max, timedelta.max)).agg(F.count(F.lit(1))).sink(NullSink()).config_error.kind is Kind.LIMIT_TOO_LARGE


def test_both_caps_on_sliding_windows_are_refused_when_hit(spark):
    rows = timeline("both", 60, False)
    pipe = Pipe.from_iter(spark, [(T0 + t * S, k, n) for t, k, n in rows], "ts timestamp_ntz, k int, n int", "ts")
    policy = WindowPolicy.sliding(8 * S, 4 * S)
    with pytest.raises(StageError, match="both caps"):
        pipe.window_by_key("k", WindowSpec(policy, 2, 2))
    assert pipe.window_by_key("k", WindowSpec(policy, 1000, 2)).agg(F.count(F.lit(1)).alias("c")).df.count() > 0


def test_plain_windows_sum_before_they_shuffle(spark):
    """No row is sorted or numbered where no cap is hit."""
    pipe = Pipe.from_df(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_id", "ts")
    out = pipe.window_by_key("user_id", WindowPolicy.tumbling(3600 * S)).agg(F.sum("value").alias("v")).df
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("partial_sum") > plan.index("Exchange hashpartitioning") and plan.count("Exchange") == 1
    assert grouping.steady(pipe.df, ["event_id"], "ts") and not grouping.steady(pipe.df.withColumn("ts", F.when(F.col("event_id") % 9 == 1, F.lit(T0)).otherwise(F.col("ts"))), ["event_id"], "ts")


# -- configuration --------------------------------------------------------------


@pytest.mark.parametrize("spec,kind", [
    (WindowPolicy.tumbling(0 * S), Kind.ZERO_DURATION),
    (WindowPolicy.session(0 * S), Kind.ZERO_DURATION),
    (WindowPolicy.sliding(S, 0 * S), Kind.ZERO_DURATION),
    (WindowPolicy.sliding(5 * S, 6 * S), Kind.SLIDE_EXCEEDS_SIZE),
    (WindowPolicy.sliding(1025 * S, S), Kind.TOO_MANY_OVERLAPPING_WINDOWS),
    (WindowPolicy.tumbling(S).max_items(0), Kind.ZERO_LIMIT),
    (WindowPolicy.tumbling(S).max_keys(0), Kind.ZERO_LIMIT),
])
def test_window_configuration(spark, spec, kind):
    assert timed(spark, (0, 1)).stage_id("w").window(spec).agg(F.count(F.lit(1))).sink(NullSink()).config_error == ConfigError(kind, "w")


@pytest.mark.parametrize("policy,kind", [
    (BatchPolicy(), Kind.NO_BATCH_TRIGGER),
    (BatchPolicy().max_items(0), Kind.ZERO_LIMIT),
    (BatchPolicy().max_age(0 * S), Kind.ZERO_DURATION),
    (BatchPolicy().max_bytes(5), Kind.BYTES_REQUIRE_BYTE_SIZE),
])
def test_batch_configuration(spark, policy, kind):
    assert timed(spark, (0, 1)).stage_id("grouper").batch(policy).agg(F.count(F.lit(1))).sink(NullSink()).config_error == ConfigError(kind, "grouper")


def test_other_configuration(spark):
    for n, bad in (((1 << 20) + 1, True), (0, False), (1 << 20, False)):
        error = ints(spark, 1).buffer(n).sink(NullSink()).config_error
        assert (error is not None and error.kind is Kind.LIMIT_TOO_LARGE) == bad
    assert ints(spark, 1).idle_tick(0 * S).sink(NullSink()).config_error.kind is Kind.ZERO_DURATION
    assert ints(spark, 1).try_map_retry(RetryPolicy(0), lambda r: r, "m int").sink(NullSink()).config_error.kind is Kind.ZERO_LIMIT
    first = ints(spark, 1).buffer(1 << 21).idle_tick(0 * S).sink(NullSink()).config_error
    assert first.kind is Kind.LIMIT_TOO_LARGE


# -- lines ----------------------------------------------------------------------


def lines(spark, tmp_path, data, source=ReaderSource, **options):
    path = tmp_path / "in.txt"
    path.write_bytes(data)
    s = source(str(path), **options)
    return [r.line for r in s.read(spark).orderBy(*s.order).collect()]


def test_lines(spark, tmp_path):
    def rule(data):
        """Lines end with \\n, which with a \\r before it is cut off; so is one \\r at the very end; no line follows the last end."""
        parts = data.split(b"\n")
        parts = parts[:-1] if not parts[-1] else parts
        return [(p[:-1] if p.endswith(b"\r") else p).decode() for p in parts]

    rng = random.Random(12)
    for data in (b"", b"\n\n", b"one\r\n\r\ntwo", b"q\r", b"left\rright\n", *(b"".join(rng.choice([b"ab", b"\n", b"\r\n", b"x"]) for _ in range(12)) for _ in range(4))):
        assert lines(spark, tmp_path, data) == rule(data), data
    assert lines(spark, tmp_path, b"sevenXX\n", max_line_len=7) == ["sevenXX"]
    for data, line in ((b"a\nb\neight888\n", 3), (b"sevenXX\r\n", 1)):
        with pytest.raises(LineTooLong) as e:
            lines(spark, tmp_path, data, max_line_len=7)
        assert (e.value.line, e.value.limit) == (line, 7)
    long = b"up\nmountains\r\nsea\n"
    assert lines(spark, tmp_path, long, max_line_len=5, on_overflow=LineOverflow.TRUNCATE) == ["up", "mount", "sea"]
    assert lines(spark, tmp_path, long, max_line_len=5, on_overflow=LineOverflow.SKIP) == ["up", "sea"]
    broken = b"fine\nfine\nbad \xc3\nfine\n"
    with pytest.raises(InvalidUtf8) as e:
        lines(spark, tmp_path, broken)
    assert e.value.line == 3
    assert lines(spark, tmp_path, broken, lossy=True) == ["fine", "fine", "bad \ufffd", "fine"]
    assert lines(spark, tmp_path, b"\x80\r\n\x00\n", ByteLinesSource) == [b"\x80", b"\x00"]


def test_writer(spark, tmp_path):
    strings(spark, "b", "a").map(F.col("s").alias("value")).sink(WriterSink(str(tmp_path / "out"))).run()
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b"b\na\n"


# -- runs -------------------------------------------------------------------------


class Broken(Sink):
    closed = 0

    def write(self, df, order):
        raise OSError("disk")

    def close(self):
        self.closed += 1


def test_sink_errors_and_drivers(spark):
    sink = Broken()
    with pytest.raises(SinkError) as e:
        ints(spark, 1).sink(sink).run()
    assert e.value.downcast(OSError) is not None and sink.closed == 1
    got = []
    assert ints(spark, 2, 1).sink(FnSink(lambda r: got.append(r.n))).run_with(SyncDriver()).items_out == 2 and got == [2, 1]
    assert ints(spark, 1).sink(NullSink()).run_threaded().items_out == 1


def test_events_and_cancel(spark):
    seen = []
    parse(strings(spark, "1", "x"), ErrorPolicy.CONTINUE).observe(lambda e: seen.append(e.kind)).sink(NullSink()).run()
    assert seen == ["started", "stage_error", "finished"]
    pipeline = ints(spark, 1).sink(NullSink())
    pipeline.cancel_handle().cancel()
    with pytest.raises(Cancelled):
        pipeline.run()
    assert not pipeline.is_finished


def test_cancel_within_a_backoff():
    script = os.path.join(os.path.dirname(__file__), "cancelled_run.py")
    done = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=200)
    assert done.stdout.split() == ["Cancelled", "True", "Closed", "True"], done.stderr[-2000:]


def test_sinks_are_closed_on_every_path(spark):
    log = []

    class Noisy(Sink):
        def __init__(self, name, fails=()):
            self.name, self.fails = name, fails

        def _do(self, what):
            log.append((self.name, what))
            if what in self.fails:
                raise OSError(f"{self.name} {what}")

        def write(self, df, order):
            self._do("write")
            return df.count()

        def flush(self):
            self._do("flush")

        def close(self):
            self._do("close")

    def run(main, dead, policy=ErrorPolicy.DEAD_LETTER, rows=MIXED):
        log.clear()
        told = []
        pipeline = parse(strings(spark, *rows), policy).dead_letter(dead).observe(lambda e: told.append((e.kind, e.stage, e.error)) if e.kind == "teardown_error" else None).sink(main)
        try:
            pipeline.run()
        except Exception as e:
            return e, told
        return None, told

    ends = [("main", "flush"), ("main", "close"), ("dead", "flush"), ("dead", "close")]
    assert run(Noisy("main"), Noisy("dead"))[0] is None and log == [("main", "write"), ("dead", "write"), *ends]
    error, told = run(Noisy("main", {"write", "close"}), Noisy("dead", {"close"}))
    assert "main write" in str(error) and log == [("main", "write"), *ends] and told == [("teardown_error", "sink", "main close"), ("teardown_error", "dead_letter", "dead close")]
    error, told = run(Noisy("main", {"flush"}), Noisy("dead", {"flush"}))
    assert isinstance(error, SinkError) and "main flush" in str(error) and told == [("teardown_error", "dead_letter", "dead flush")]
    error, told = run(Noisy("main"), Noisy("dead"), ErrorPolicy.FAIL_FAST)
    assert isinstance(error, StageError) and log[-4:] == ends and not told
    log.clear()
    with pytest.raises(OSError) as e:
        TeeSink(Noisy("one", {"close"}), Noisy("two", {"close"})).close()
    assert "one close" in str(e.value) and e.value.__notes__ == ["and then: two close"] and log == [("one", "close"), ("two", "close")]


# -- streams -----------------------------------------------------------------------


def files(spark, path, rows, schema, each):
    for k in range(0, len(rows), each):
        spark.createDataFrame(rows[k : k + each], schema).coalesce(1).write.mode("append").parquet(str(path))


def test_steps(spark, tmp_path):
    from flowspark.streaming import Step, StepRunner

    files(spark, tmp_path / "in", [(k, 7 - k) for k in range(3)], "seq long, n int", 1)
    got = []
    runner = StepRunner(spark, str(tmp_path / "in"), "seq long, n int", str(tmp_path / "cp"), lambda df, no: got.extend(r.n for r in df.collect()))
    assert runner.step() is Step.ITEM and len(got) == 1
    assert runner.step() is Step.ITEM and len(got) == 2
    assert runner.finish() == 3 and sorted(got) == [5, 6, 7] and runner.is_finished and runner.step() is Step.DONE


SCHEMA = "ts timestamp_ntz, k int, n int"


def stream_windows(spark, tmp_path, spec, keys, got):
    from flowspark.streaming import StreamWindows

    def emit(df, no):
        got.extend(((r.k if keys else 0), (r.window_start - T0) // S, (r.window_end - T0) // S, tuple(sorted(r.ns))) for r in df.collect())

    return StreamWindows(spark, str(tmp_path / "state"), SCHEMA, ["n"], "ts", spec, keys, (F.collect_list("n").alias("ns"),), emit)


@pytest.mark.parametrize("kind,options,keyed", [("tumbling", dict(size=10, most=3), True), ("sliding", dict(size=9, step=4), True), ("session", dict(size=4, most=2), True), ("session", dict(size=3), False), ("tumbling", dict(size=14, keys=2), True), ("session", dict(size=9, keys=2), True), ("sliding", dict(size=10, step=4, keys=2), True)])
def test_streams_equal_tables(spark, tmp_path, kind, options, keyed):
    """Micro-batches of any cut give the windows of the whole: one grid, one clock for all keys, late rows and all."""
    from flowspark.streaming import StepRunner

    rows = timeline(f"stream {kind}", 60, True)
    model = Model(kind, **options)
    for t, k, n in rows:
        model.feed(t, k if keyed else 0, n)
    files(spark, tmp_path / "in", [(T0 + t * S, k, n) for t, k, n in rows], SCHEMA, 22)
    got: list = []
    body = stream_windows(spark, tmp_path, policy_of(kind, **options), ["k"] if keyed else [], got)
    runner = StepRunner(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "cp"), body)
    runner.step()
    assert len(got) < len(model.out) + 9
    runner.finish()
    assert sorted(got) == model.done()


def test_idle_ticks_close_windows(spark, tmp_path):
    from flowspark.streaming import Step, StepRunner

    files(spark, tmp_path / "in", [(T0 + 2 * S, 1, 0), (T0 + 5 * S, 2, 1)], SCHEMA, 2)
    got: list = []
    runner = StepRunner(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "cp"), stream_windows(spark, tmp_path, WindowPolicy.session(20 * S), ["k"], got), idle=8 * S)
    assert runner.step() is Step.ITEM and not got
    assert runner.step() is Step.IDLE and not got  # 13 s
    runner.tick(T0 + 23 * S)
    assert got == [(1, 2, 2, (0,))]  # 21 s after its last row
    assert runner.step() is Step.IDLE and sorted(got) == [(1, 2, 2, (0,)), (2, 5, 5, (1,))]  # 31 s
    runner.finish()
    assert len(got) == 2


# -- names and nulls ----------------------------------------------------------------


def test_columns_with_the_names_of_groups(spark):
    """The user's columns keep their values next to the engine's, in windows and in batches."""
    names = ["at", "lru", "session", "chunk", "window_start", "window_end", "batch_id", "_part", "_place", "_no", "_us", "_size", "_k", "_n"]
    rows = [(T0 + k * S, k % 2, *[7 * k + j for j in range(len(names))]) for k in range(12)]
    pipe = Pipe.from_iter(spark, rows, "ts timestamp_ntz, key int, " + ", ".join(f"`{n}` int" for n in names), "ts")
    sums = [F.sum(n).alias(f"sum{j}") for j, n in enumerate(names)]
    want = [sum(7 * k + j for k in range(12)) for j in range(len(names))]
    for grouped in (
        pipe.window(WindowPolicy.tumbling(5 * S)),
        pipe.window_by_key("key", WindowPolicy.session(3 * S).max_items(4).max_keys(1)),
        pipe.window_by_key("chunk", WindowPolicy.tumbling(5 * S)),
        pipe.batch(BatchPolicy().max_items(5)),
        pipe.batch_bytes(BatchPolicy().max_bytes(20).max_age(4 * S), F.col("_size")),
    ):
        got = grouped.agg(*sums).df.agg(*[F.sum(f"sum{j}") for j in range(len(names))]).first()
        assert list(got) == want
    whole = pipe.window(WindowPolicy.tumbling(100 * S)).items(*names).df.first()["items"]
    assert [tuple(x) for x in whole] == [r[2:] for r in rows]


def test_null_clocks(spark):
    """A null clock is the instant before it; before the first known instant it is that one, and no row is lost."""
    pairs = [(None, 0), (0, 1), (None, 2), (7, 3), (None, 4), (3, 5), (12, 6), (None, 7)]
    filled = [0, 0, 0, 7, 7, 7, 12, 12]
    pipe = Pipe.from_iter(spark, [(None if t is None else T0 + t * S, n) for t, n in pairs], "ts timestamp_ntz, n int", "ts")
    for spec in (WindowPolicy.tumbling(5 * S), WindowPolicy.session(4 * S), WindowPolicy.sliding(6 * S, 3 * S)):
        known = Pipe.from_iter(spark, [(T0 + t * S, n) for t, (_, n) in zip(filled, pairs)], "ts timestamp_ntz, n int", "ts")
        a, b = ([(r.window_start, [x.n for x in r["items"]]) for r in p.window(spec).items("n").df.orderBy("window_start").collect()] for p in (pipe, known))
        assert a == b and sorted({n for _, g in a for n in g}) == list(range(8))
    by_clock = Pipe.from_df(pipe.df.drop("seq"), "ts", "ts").window(WindowPolicy.tumbling(5 * S)).agg(F.count(F.lit(1)).alias("n")).df
    assert sum(r.n for r in by_clock.collect()) == 8
    nothing = Pipe.from_iter(spark, [(None, 1), (None, 2)], "ts timestamp_ntz, n int", "ts").window(WindowPolicy.tumbling(5 * S)).agg(F.count(F.lit(1)).alias("n")).df
    assert [r.n for r in nothing.collect()] == [2]


def test_source_id(spark):
    from flowspark.errors import SourceError

    class Broken:
        order = ["n"]

        def read(self, spark):
            raise OSError("no such table")

    with pytest.raises(SourceError) as e:
        Pipe.from_source(Broken(), spark, source_id="orders feed")
    assert e.value.stage == "orders feed" and Pipe.from_source(IterSource([(1,)], "n int"), spark, source_id="feed").source == "feed"
