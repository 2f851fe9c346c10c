import oracle
import pytest
from pyspark.sql import functions as F

from flowspark.plans import queries, run_queries

SF = "/root/testdata/sf0.001"
QUERIES = {**queries.QUERIES, **run_queries.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **run_queries.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    oracle.same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", ["window_session", "stream_session_keyed"])
def test_long_sessions_are_whole(spark, tmp_path, name):
    """One session of more items than the default cap is one window, as in the SQL."""
    rows = spark.range((1 << 20) + 9).selectExpr("id as event_id", "timestamp_micros(id * 1000000) as ts", "0L as user_id", "'view' as event_type", "0.5 * (id % 7) as value", "'{}' as props")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "events.parquet")  # one file, which DuckDB reads too
    oracle.same(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], str(tmp_path))
