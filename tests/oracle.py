"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return made


def plain(value: object) -> object:
    if isinstance(value, float):
        return repr(value)
    return value.isoformat() if hasattr(value, "isoformat") else None if value is None else str(value)


def assert_same(spark_rows, columns: list[str], connection, sql: str) -> None:
    names = sorted(columns)
    cursor = connection.execute(sql)
    found = [c[0] for c in cursor.description]
    assert sorted(found) == names
    at = [found.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in names) for r in spark_rows), key=str)
    assert got == want
