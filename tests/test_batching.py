"""Batch beginnings worked out by ranges, against one item after another."""

import random

import pytest

from flowspark.operators.batching import Limits, batch_starts


def model(rows, limits):
    """``rows``: (size, instant or None); the numbers of the first items of batches."""
    out, n, total, opened, now = [], 0, 0, None, next((u for _, u in rows if u is not None), 0)
    for k, (size, us) in enumerate(rows):
        now = now if us is None else us
        if not n:
            out.append(k)
            opened, total = now, 0
        n, total = n + 1, total + size
        if limits.items is not None and n >= limits.items or limits.bytes is not None and total >= limits.bytes or limits.age is not None and now - opened >= limits.age:
            n = 0
    return out


def drawn(rng, n, back):
    t, rows = 1_000, []
    for _ in range(n):
        t += rng.choice([0, 0, 1, 3, 9, -back])
        rows.append((rng.choice([0, 0, 1, 5, 20]), None if rng.random() < 0.1 else t))
    return rows


@pytest.mark.parametrize("walk_limit", [0, 10**6])
@pytest.mark.parametrize("limits", [Limits(bytes=30), Limits(age=7), Limits(items=4, bytes=17), Limits(items=50, bytes=400, age=60), Limits(bytes=10**9), Limits(age=10**9, items=3), Limits(items=90, age=5)])
def test_ranges(spark, limits, walk_limit):
    """Ranges of any size, some with a single row, batches longer than ranges, clocks that run back or are null; links walked and doubled."""
    rng = random.Random(str(limits) + str(walk_limit))
    rows = drawn(rng, 240, rng.choice([0, 2, 40]))
    part, placed, at = 0, [], 0
    for k, (size, us) in enumerate(rows):
        if rng.random() < 0.06:
            part, at = part + rng.randint(1, 3), k  # numbers of ranges have gaps
        placed.append((part, k - at, size, us))
    first = {}
    for k, (p, i, *_) in enumerate(placed):
        first[(p, i)] = k
    df = spark.createDataFrame(rng.sample(placed, len(placed)), "_part int, _place long, _size long, _us long").repartition(3)
    got = sorted(first[(r._p, r._i)] for r in batch_starts(df, limits, walk_limit).collect())
    assert got == model(rows, limits)


def test_edges(spark):
    empty = spark.createDataFrame([], "_part int, _place long, _size long, _us long")
    assert batch_starts(empty, Limits(bytes=1)).count() == 0
    nulls = spark.createDataFrame([(k // 3, k % 3, 1, None) for k in range(9)], "_part int, _place long, _size long, _us long")
    assert batch_starts(nulls, Limits(age=1)).count() == 1 and batch_starts(nulls, Limits(bytes=1)).count() == 9


def test_no_single_task(spark):
    """No exchange of the items into one partition."""
    rows = spark.range(1000).selectExpr("cast(id / 100 as int) as _part", "id % 100 as _place", "id % 7 as _size", "id as _us")
    plan = spark._jvm.PythonSQLUtils.explainString(batch_starts(rows, Limits(items=9, bytes=40, age=50))._jdf.queryExecution(), "simple")
    assert "SinglePartition" not in plan and "FlatMapGroupsInArrow" in plan
