"""Run queries against DuckDB: `python -m checks.compare [--sf 0.01] [names...]`."""

from __future__ import annotations

import argparse
import sys
import time

import duckdb
import pandas as pd

from quantloom.session import build_session

from .catalog import ENTRIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        frame[column] = frame[column].map(lambda v: None if v is None or v is pd.NA or v != v else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v))
        frame[column] = frame[column].map(repr)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str:
    """Empty when both hold the same rows under the same names, in any order."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    a, b = normal(left), normal(right)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = (a != b).any(axis=1)
    if not wrong.any():
        return ""
    columns = [c for c in a.columns if (a[c] != b[c]).any()]
    return f"{int(wrong.sum())} of {len(a)} rows differ in {columns}\n{a[wrong].head(3).to_string()}\n{b[wrong].head(3).to_string()}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    sf_dir = f"/root/testdata/sf{options.sf}"
    spark = build_session("checks", cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in options.names or ENTRIES:
        item = ENTRIES[name]
        try:
            started = time.time()
            mine = item.run(spark, sf_dir).toPandas()
            spent = time.time() - started
            started = time.time()
            problem = differences(mine, con.execute(item.sql).fetchdf()) if item.sql else ""
            status = "ok" if not problem else "DIFF"
            label = "" if item.sql else " rows only"
            print(f"{status} {name} rows={len(mine)} spark={spent:.1f}s duckdb={time.time() - started:.1f}s{label} {problem}", flush=True)
            failed += bool(problem)
        except Exception as error:
            failed += 1
            print(f"ERROR {name}: {str(error)[:900]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
