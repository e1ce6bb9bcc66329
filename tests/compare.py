"""Runs a query's SQL with DuckDB and compares bags of rows, columns by name."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def _plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    return v


def bag(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        con.sql("set timezone = 'UTC'")
        for file in Path(sf_dir).glob("*.parquet"):
            con.sql(f"create view {file.stem} as select * from read_parquet('{file}')")
        found = con.sql(sql)
        return found.columns, found.fetchall()


def assert_same(df: DataFrame, sf_dir: str, sql: str) -> None:
    names, rows = oracle(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    ours, theirs = bag(df.columns, [tuple(r) for r in df.collect()]), bag(names, rows)
    assert sum(ours.values()) == sum(theirs.values())
    assert not list((ours - theirs).items())[:3], (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
