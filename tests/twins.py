"""Comparison of a query with its SQL twin in DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from '{files}'")
    return con


def plain(value: object) -> str:
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value) + 0.0:.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def assert_twin(query, sql: str, spark, folder: str) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = connect(folder).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    assert ours == theirs
