"""Batches and custom stages over streams, with restarts and crashes, against sequential models."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark import BatchPolicy, ErrorPolicy, StageError, WindowPolicy
from flowspark.operators import grouping
from flowspark.operators.stages import Stage
from flowspark.streaming import StreamBatches, StreamStage, StreamWindows
from flowspark.streaming.state import StateLog

T0, S = datetime(2031, 5, 17, 6), timedelta(seconds=1)
SCHEMA = "n int, ts timestamp_ntz, s string"


def model(rows, policy):
    out, now, opened, at = [], [], None, None
    for n, t, s in rows:
        at = t if t is not None else at
        opened = opened if now else at
        now.append((n, s))
        old = policy.age_limit is not None and (at - opened) * S >= policy.age_limit
        if len(now) == policy.items_limit or policy.bytes_limit is not None and sum(len(x) for _, x in now) >= policy.bytes_limit or old:
            out.append([n for n, _ in now])
            now = []
    return out, [n for n, _ in now]


def frame(spark, rows):
    return spark.createDataFrame([(n, None if t is None else T0 + t * S, s) for n, t, s in rows], SCHEMA)


def drawn(seed, n):
    rng, t, rows = random.Random(seed), 0, []
    for k in range(n):
        t += rng.choice([0, 1, 2, 9, -3])
        rows.append((k, t if rng.random() > 0.1 or not k else None, "z" * rng.choice([0, 2, 7, 30])))
    return rng, rows


@pytest.mark.parametrize("policy", [BatchPolicy().max_items(4), BatchPolicy().max_bytes(40).max_items(9), BatchPolicy().max_age(11 * S).max_bytes(90)])
def test_batches_of_any_cut(spark, tmp_path, policy):
    """Random cuts, a new object for each micro-batch, one emission that fails and one micro-batch run twice: the batches of the table."""
    rng, rows = drawn(str(policy), 70)
    cuts = sorted(rng.sample(range(1, 70), 4))
    got, fail = {}, {2}

    def emit(df, no):
        if no in fail:
            fail.remove(no)
            raise OSError("lost")
        for r in df.collect():
            assert got.setdefault(r.batch_id, sorted(r.ns)) == sorted(r.ns)

    def body():
        size = F.octet_length("s") if policy.bytes_limit is not None else None
        return StreamBatches(spark, str(tmp_path / "state"), SCHEMA, ["n"], policy, size, "ts", (F.collect_list("n").alias("ns"),), emit)

    for no, (a, b) in enumerate(zip([0, *cuts], [*cuts, 70])):
        part = frame(spark, rows[a:b])
        try:
            body()(part, no)
        except OSError:
            body()(part, no)  # Spark runs it again
        if no == 3:
            body()(part, no)
    whole, rest = model(rows, policy)
    assert [got[k] for k in sorted(got)] == whole
    body().finish()
    assert [got[k] for k in sorted(got)] == whole + [rest] * bool(rest) and sorted(got) == list(range(len(got)))
    body().finish()  # nothing is open


def test_idle_tick_closes_a_batch_by_age(spark, tmp_path):
    got = []
    body = StreamBatches(spark, str(tmp_path), SCHEMA, ["n"], BatchPolicy().max_age(10 * S), None, "ts", (F.collect_list("n").alias("ns"),), lambda df, no: got.extend(sorted(r.ns) for r in df.collect()))
    body.tick(T0)  # before any row
    body(frame(spark, [(0, 0, ""), (1, 4, "")]), 0)
    body.idle(3 * S)
    body.tick(T0 + 9 * S)
    assert got == []
    body.idle(1 * S)  # 10 s after the batch was opened
    assert got == [[0, 1]]
    body(frame(spark, [(2, 30, ""), (3, 31, "")]), 1)
    assert got == [[0, 1]]
    body.finish()
    assert got == [[0, 1], [2, 3]]


class Pairs(Stage):
    """Emits rows two by two, counts ticks, and gives what is left at the end."""

    def __init__(self):
        self.held, self.ticks = [], 0

    def process(self, row):
        if row["s"] == "bad":
            raise ValueError("bad row")
        self.held.append(row["n"])
        if len(self.held) == 2:
            yield {"out": "+".join(map(str, self.held))}
            self.held = []

    def tick(self):
        self.ticks += 1
        yield {"out": f"tick {self.ticks}"}

    def flush(self):
        yield {"out": f"left {self.held} after {self.ticks} ticks"}


@pytest.mark.parametrize("keys", [[], ["s"]])
def test_stage_goes_on_from_its_state(spark, tmp_path, keys):
    got = []

    def body():
        return StreamStage(spark, str(tmp_path), SCHEMA, ["n"], Pairs(), "out string", keys, lambda df, no: got.extend((r["s"] if keys else "", r.out) for r in df.orderBy(*keys, "out_no").collect()))

    body()(frame(spark, [(0, 0, "a"), (1, 0, "b"), (2, 0, "a")]), 0)
    body()(frame(spark, [(3, 0, "b"), (4, 0, "a")]), 1)
    body().tick()
    body().finish()
    if keys:
        assert got == [("a", "0+2"), ("b", "1+3"), ("a", "tick 1"), ("b", "tick 1"), ("a", "left [4] after 1 ticks"), ("b", "left [] after 1 ticks")]
    else:
        assert [x for _, x in got] == ["0+1", "2+3", "tick 1", "left [4] after 1 ticks"]


def test_stage_over_many_keys_and_odd_ones(spark, tmp_path):
    """States come before their keys' rows, each key once a call: also null, NaN and both zeros, and keys apart by a microsecond."""
    got, us = [], timedelta(microseconds=1)
    schema = "k double, t timestamp_ntz, s string, __state int"

    def body():
        return StreamStage(spark, str(tmp_path), schema, ["s"], Odd(), "out string", ["k", "t"], lambda df, no: got.extend((str(r.k), r.t, r.out_no, r.out) for r in df.collect()))

    keys = [(k, T0 + j * us) for k in [*map(float, range(1, 40)), None, float("nan"), 0.0] for j in range(2)]
    for no in range(2):
        rows = [(-k if k == 0 and no else k, t, s, no) for k, t in keys[no:] for s in ("b", None, "a")]
        body()(spark.createDataFrame(rows, schema), no)
    plan = body()._ran(None, spark.createDataFrame(rows, schema), "")._jdf.queryExecution().toString()
    assert "CoGroup" not in plan  # no group of its own in Python for each key
    body().finish()
    first, name = keys[0], lambda k: str(k) if k != 0 else "0.0"
    assert sorted(got) == sorted((name(k), t, 0, " ".join(["a0 b0 None0"] + ["a1 b1 None1"] * ((k, t) != first))) for k, t in keys)


class Odd(Stage):
    def __init__(self):
        self.seen = []

    def process(self, row):
        self.seen.append(f"{row['s']}{row['__state']}")
        return iter(())

    def flush(self):
        yield {"out": " ".join(self.seen)}


def test_stage_policies(spark, tmp_path):
    rows = frame(spark, [(0, 0, "a"), (1, 0, "bad"), (2, 0, "a")])
    for policy in ErrorPolicy:
        got, dead = [], []
        body = StreamStage(spark, str(tmp_path / policy.name), SCHEMA, ["n"], Pairs(), "out string", [], lambda df, no: got.extend(r.out for r in df.collect()), policy, lambda df, no: dead.extend(map(tuple, df.collect())), "pairs")  # noqa: B023
        if policy is ErrorPolicy.FAIL_FAST:
            with pytest.raises(StageError) as e:
                body(rows, 0)
            assert e.value.stage == "pairs" and got == [] and StateLog(spark, str(tmp_path / policy.name)).latest() is None
        else:
            body(rows, 0)
            assert got == ["0+2"]
            assert [d[:3] for d in dead] == ([("pairs", "bad row", "ValueError")] if policy is ErrorPolicy.DEAD_LETTER else [])


@pytest.mark.parametrize("spec", [WindowPolicy.session(3 * S), WindowPolicy.tumbling(5 * S).max_keys(2)])
def test_a_call_works_out_its_windows_once(spark, tmp_path, monkeypatch, spec):
    """A steady clock is not clamped; sessions are not found again for each reader; keys are replayed with their rows, without a join back."""
    plans, kept, got, settled = [], [], [], grouping.settled
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(grouping, "settled", lambda df: (plans.append(plan(df)), settled(df))[1])
    monkeypatch.setattr(grouping, "clamped", lambda *_: pytest.fail("the clock is steady"))
    body = StreamWindows(spark, str(tmp_path), SCHEMA, ["n"], "ts", spec, ["s"], (F.count(F.lit(1)).alias("c"),), lambda df, no: got.extend(r.c for r in df.collect()))
    keep = body._keep
    monkeypatch.setattr(body, "_keep", lambda no, closed, left, *more: (kept.extend((plan(closed), plan(left))), keep(no, closed, left, *more)))
    body(frame(spark, [(k, k, "abc"[k % 3]) for k in range(20)]), 0)
    assert not any("Window [" in p for p in kept) and not any("MapInArrow" in p and "Join" in p for p in plans)
    body.finish()
    assert sum(got) == 20


def test_a_crash_between_writes_loses_nothing(spark, tmp_path):
    """Windows: state written but not marked, marked but not emitted; old versions go."""
    got, broken = [], {1}

    def emit(df, no):
        if no in broken:
            broken.remove(no)
            raise OSError("down")
        got.extend(sorted((r.window_start - T0) // S for r in df.collect()))

    def body():
        return StreamWindows(spark, str(tmp_path), SCHEMA, ["n"], "ts", WindowPolicy.tumbling(10 * S), (), (F.count(F.lit(1)).alias("c"),), emit)

    body()(frame(spark, [(0, 0, ""), (1, 12, "")]), 0)
    (tmp_path / "v-1-9").mkdir()  # a version without its mark
    with pytest.raises(OSError):
        body()(frame(spark, [(2, 25, "")]), 1)
    body()(frame(spark, [(2, 25, "")]), 1)  # run again, from the version before
    body()(frame(spark, [(3, 47, "")]), 2)
    body().finish()
    assert got == [0, 10, 20, 40]
    log = StateLog(spark, str(tmp_path))
    assert {v.no for v in log.versions()} <= {1, 2} and all(v.emitted for v in log.versions()[-1:])
