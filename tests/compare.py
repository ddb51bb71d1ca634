"""Rows of a query and of its SQL, made comparable."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def sql_rows(sql: str, folder: str, columns: list[str]) -> list[tuple]:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(x) for x in columns]
    return sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)


def spark_rows(df) -> list[tuple]:
    return sorted((tuple(map(plain, row)) for row in df.collect()), key=repr)


def same(df, sql: str, folder: str) -> None:
    df = df.select(sorted(df.columns))
    assert spark_rows(df) == sql_rows(sql, folder, df.columns)
