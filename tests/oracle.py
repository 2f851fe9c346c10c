"""Spark's result and DuckDB's over the same tables, as sorted rows by column name."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path}'")
    got = con.sql(sql)
    cols = sorted(got.columns)
    return cols, got.select(*cols).fetchall()


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, [tuple(r) for r in df.select(*cols).collect()]


def same(df, sql: str, sf_dir: str) -> None:
    (c1, a), (c2, b) = spark_rows(df), duck_rows(sql, sf_dir)
    assert c1 == c2, (c1, c2)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (x, y)
