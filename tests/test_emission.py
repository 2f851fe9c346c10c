"""Windows come out in the order of a sequential run, and what follows them sees that order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark import BatchPolicy, WindowPolicy, WindowSpec
from flowspark.plans.pipe import Pipe
from flowspark.sinks import VecSink

T0, S = datetime(2031, 5, 17, 6), timedelta(seconds=1)


class Run:
    """Tumbling and session windows by key, one item after another; groups in the order in which they come out."""

    def __init__(self, kind, size, most=None, keys=None):
        self.kind, self.size, self.most, self.keys = kind, size, most, keys
        self.now = self.anchor = None
        self.live, self.used, self.out = {}, [], []  # key: dict; keys, least recent first

    def due(self, w):
        return w["last"] + self.size + 1e-6 if self.kind == "session" else w["start"] + self.size

    def shut(self, k):
        w = self.live.pop(k)
        self.used.remove(k)
        if w["items"]:
            self.out.append((k, w["items"]))

    def feed(self, n, t, k):
        self.now = t = t if self.now is None else max(self.now, t)
        self.anchor = t if self.anchor is None else self.anchor
        for _, _, x in sorted((self.due(w), w["born"], x) for x, w in self.live.items() if self.due(w) <= t):
            self.shut(x)
        if k not in self.live:
            if self.keys and len(self.live) >= self.keys:
                self.shut(self.used[0])
            start = t if self.kind == "session" else self.anchor + (t - self.anchor) // self.size * self.size
            self.live[k] = {"start": start, "last": t, "items": [], "born": n}
        else:
            self.used.remove(k)
        self.used.append(k)
        w = self.live[k]
        w["items"], w["last"] = [*w["items"], n], t
        if len(w["items"]) == self.most:
            self.out.append((k, w["items"]))
            w["items"] = []

    def end(self):
        for k in sorted(self.live, key=lambda k: self.live[k]["born"]):
            self.shut(k)
        return self.out


def timeline(seed, ties):
    rng, t, rows = random.Random(seed), 0, []
    for n in range(160):
        t += rng.choice([0, 0, 1, 2, -2, 6] if ties else [1, 2, 3, -2, 9])
        rows.append((n, t, rng.randint(0, 5)))
    return rows


CASES = [("tumbling", dict(size=9)), ("tumbling", dict(size=20, most=3)), ("tumbling", dict(size=40, keys=3)), ("tumbling", dict(size=30, most=2, keys=2)), ("session", dict(size=4)), ("session", dict(size=7, most=3)), ("session", dict(size=12, keys=2))]


@pytest.mark.parametrize("kind,options", CASES)
def test_windows_come_out_in_order(spark, kind, options):
    rows = timeline(f"{kind} {options}", kind == "tumbling")
    run = Run(kind, **options)
    for row in rows:
        run.feed(*row)
    want = run.end()
    pipe = Pipe.from_iter(spark, [(T0 + t * S, k, n) for n, t, k in rows], "ts timestamp_ntz, k int, n int", "ts")
    policy = WindowPolicy.tumbling(options["size"] * S) if kind == "tumbling" else WindowPolicy.session(options["size"] * S)
    windows = pipe.window_by_key("k", WindowSpec(policy, options.get("most"), options.get("keys"))).items("n")
    sink = VecSink()
    windows.sink(sink).run()
    assert [(r["k"], [x["n"] for x in r["items"]]) for r in sink.handle().take()] == want
    batches = windows.map("k", "n").batch(BatchPolicy().max_items(4)).items("k").df.orderBy("batch_id").collect()
    assert [[x.k for x in r["items"]] for r in batches] == [[k for k, _ in want[i : i + 4]] for i in range(0, len(want), 4)]


def test_the_session_that_ends_first_comes_first(spark):
    rows = [("a", 0), ("b", 1), ("a", 4), ("a", 8), ("a", 12), ("c", 30)]
    pipe = Pipe.from_iter(spark, [(T0 + t * S, k) for k, t in rows], "ts timestamp_ntz, k string", "ts")
    sink = VecSink()
    pipe.window_by_key("k", WindowPolicy.session(5 * S)).agg(F.count(F.lit(1)).alias("n")).sink(sink).run()
    assert [r["k"] for r in sink.handle().take()] == ["b", "a", "c"]
