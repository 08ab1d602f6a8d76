"""Side-by-side run of the registered queries and their SQL twins."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(df, connection, sql: str) -> str | None:
    """None when both results hold the same columns and rows."""
    names, ours = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    their_names, theirs = _sorted_rows([c[0] for c in result.description], result.fetchall())
    if names != their_names:
        return f"columns {names} / {their_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} / {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference: {a} / {b}"[:600]
    return None


def main(folder: str, only: list[str]) -> int:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from ratelens.session import build_session

    spark = build_session(
        "compare",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = connect(folder), E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracles:
                outcome = difference(fn(spark, folder), connection, oracles[name]) or "same"
            else:
                outcome = f"rows only: {fn(spark, folder).count()}"
        except Exception as error:  # noqa: BLE001
            outcome = "FAILED " + str(error)[:1500]
        bad += not outcome.startswith(("same", "rows only"))
        print(f"{name:32s} {time.time() - start:6.1f}s  {outcome}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
