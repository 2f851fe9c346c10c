"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError, ConfigErrorKind


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder, but only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ConfigError(ConfigErrorKind.SHARED_DIR_MISSING)
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowspark-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df``, written and read again: evaluated once, and the same for every reader whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
