"""Cancels a run that waits within a backoff; a script of its own, as the killed workers are the session's."""

import threading
import time
from datetime import timedelta

from pyspark.sql import SparkSession

from flowspark import Backoff, Cancelled, Closed, ErrorPolicy, RetryPolicy
from flowspark.plans.pipe import Pipe
from flowspark.sinks import NullSink


def never(row):
    raise ValueError("no")


spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
retry = RetryPolicy(5).backoff(Backoff.fixed(timedelta(minutes=5)))
pipeline = Pipe.from_iter(spark, range(3), "n int").on_error(ErrorPolicy.CONTINUE).try_map_retry(retry, never, "m int").sink(NullSink())
stop = threading.Timer(4, pipeline.cancel_handle().cancel)
stop.start()
began = time.monotonic()
for expected in (Cancelled, Closed):
    try:
        pipeline.run()
    except expected:
        print(expected.__name__, time.monotonic() - began < 60)
spark.stop()
