"""Runs registered queries beside their SQL twins and compares all values.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, np.ndarray):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return "NULL"
    if isinstance(value, (float, np.floating)):
        return repr(float(value) + 0.0)
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return str(value)


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when equal, else the first difference."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if len(left) and kinds(left) != kinds(right):
        return f"types {kinds(left)} != {kinds(right)}"
    for a, b in zip(canonical(left), canonical(right)):
        if a != b:
            return f"values {a} != {b}"
    return None


if __name__ == "__main__":
    from layerweave.plans.queries import ORACLES, QUERIES
    from layerweave.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for want in names for n in QUERIES if n == want or (want.endswith("*") and n.startswith(want[:-1]))]
    spark = local_session(8)
    connection = connect(folder)
    bad = 0
    for name in names:
        try:
            started = time.time()
            result = QUERIES[name](spark, folder).toPandas()
            took = time.time() - started
            if name in ORACLES:
                started = time.time()
                expected = connection.sql(ORACLES[name]).df()
                verdict = compare(result, expected)
                sql_took = f"{time.time() - started:.1f}s"
            else:
                verdict, sql_took = None, "rows only"
        except Exception as error:  # noqa: BLE001
            verdict, took, sql_took, result = f"{type(error).__name__}: {str(error)[:1500]}", 0, "", []
        bad += verdict is not None
        print(f"{'ok ' if verdict is None else 'BAD'} {name:28s} rows={len(result):8d} spark={took:.1f}s sql={sql_took} {verdict or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    spark.stop()
