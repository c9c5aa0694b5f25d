"""Run registered queries against their SQL and compare every value."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    return value


def sorted_rows(columns, rows):
    """Columns by name, rows in a total order; values are compared exactly, floats included."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def spark_rows(df):
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(connection, sql):
    result = connection.execute(sql)
    return sorted_rows([d[0] for d in result.description], result.fetchall())


def first_difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns differ: {sorted(set(left[0]) ^ set(right[0]))}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows, expected {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(bad)} of {len(left[1])} rows differ, first {bad[0][0]}, expected {bad[0][1]}" if bad else None


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries

    from offerloom.session import build_session

    spark = build_session()
    expected, registered = oracle_sql(), queries()
    connection = oracle_connection(folder)
    failed = 0
    for name in names or registered:
        begin = time.time()
        got = spark_rows(registered[name](spark, folder))
        spent = time.time() - begin
        if name in expected:
            problem = first_difference(got, oracle_rows(connection, expected[name]))
            failed += problem is not None
            print(f"CHECK {'FAIL' if problem else 'ok  '} {name} {len(got[1])} rows {spent:.2f}s {problem or ''}", flush=True)
        else:
            print(f"CHECK rows {name} {len(got[1])} rows {spent:.2f}s", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
