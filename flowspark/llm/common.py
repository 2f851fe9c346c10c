"""Tables, shared folders and other small things that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import settled, shared_dir  # noqa: F401

#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id inside numpy arrays; larger than any id in use.
NULL_ID = (1 << 63) - 1


def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "8m") -> None:
    """Let this session send whole texts to Python in batches of bounded bytes; each is copied several times on its way."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder, for a session with small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner real sizes."""
    return settled(df)


def settle_lean(df: DataFrame) -> DataFrame:
    """The same, and the shuffle files behind ``df`` go as soon as it is written; nothing reads them again."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return settled(df)
    finally:
        spark.conf.set(key, before)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_of_id(col) -> "F.Column":
    return F.crc32(F.col(col).cast("string").cast("binary"))


def spread(rows: int, each: int, least: int = 1) -> int:
    """Partitions or buckets so that each holds about ``each`` of ``rows``."""
    return max(least, -(-rows // each))


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str, kind: str = "long") -> DataFrame:
    """``out``: the sum of ``value`` up to and with each row, by ``keys``, in the order of ``bucket`` and then ``order``."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_s"))
    past = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(past), F.lit(0)).cast(kind)).drop("_s")
    sums = sums.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, bucket]], "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, bucket]]
    both = df.join(sums, on, "inner").drop(*[f"_of_{k}" for k in [*keys, bucket]])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before")
