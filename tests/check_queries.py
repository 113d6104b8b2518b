"""Run registered queries and their SQL twins side by side.

    python tests/check_queries.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT or value is pd.NA:
        return (0, "")
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, f"{float(value):.9g}")
    return (3, str(value))


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    out = {}
    for c in sorted(df.columns):
        seen = {type(v).__name__ for v in df[c].dropna().head(50)}
        out[c] = "/".join(sorted(seen))
    return out


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    left, right = rows_of(spark_df), rows_of(sql_df)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)}/{len(right)} {sorted(spark_df.columns)}\n   spark {only_left}\n   sql   {only_right}"
    return None


def main(argv: list[str]) -> int:
    from hirelake.plans import oracle_sql, queries
    from tests.conftest import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, db = build_session(), connect(folder)
    sql, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            start = time.time()
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"{name:45s} rows {len(got)} (no SQL) {took:.1f}s")
                continue
            expected = db.execute(sql[name]).df()
            problem = compare(got, expected)
            types = kinds(got), kinds(expected)
            note = "" if types[0] == types[1] else f" types {[(c, types[0][c], types[1][c]) for c in types[0] if types[0][c] != types[1].get(c)]}"
            print(f"{name:45s} {'ok' if problem is None else 'DIFFERS ' + problem} rows {len(got)} {took:.1f}s{note}")
            failed += problem is not None
        except Exception as error:  # report and go on with the next query
            print(f"{name:45s} ERROR {str(error)[:1500]}")
            failed += 1
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
