"""Run queries beside their SQL and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, db, sql: str):
    """None if equal, else a text saying how the two differ."""
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    expected = rows_of(names, want.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in want.description}
    spark_kinds = dict(df.dtypes)
    family = lambda k: k.upper().replace("INT8", "BIGINT").replace("STRING", "VARCHAR")
    clash = [
        (n, spark_kinds[n], kinds[n]) for n in names
        if {"INTEGER": "INT", "HUGEINT": "?"}.get(kinds[n], kinds[n]) != {"INT": "INT"}.get(family(spark_kinds[n]), family(spark_kinds[n]))
    ]
    if got != expected:
        extra = [r for r in got if r not in set(expected)][:2]
        missing = [r for r in expected if r not in set(got)][:2]
        return f"{len(got)} vs {len(expected)} rows; got {extra} want {missing} types {clash}"
    return f"types {clash}" if clash else None


def main(prefixes, folder="/root/testdata/sf0.01"):
    import __spark_entry__ as entry
    from conftest import make_session

    spark, db = make_session(), database(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sorted(queries):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = queries[name](spark, folder)
            problem = compare(df, db, sql[name]) if name in sql else f"rows {len(df.collect())}"
        except Exception as error:  # noqa: BLE001 - a report of every query is wanted
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        ok = problem is None or (name not in sql and problem.startswith("rows"))
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failed", flush=True)


if __name__ == "__main__":
    main([a for a in sys.argv[1:] if not a.startswith("/")], *[a for a in sys.argv[1:] if a.startswith("/")])
