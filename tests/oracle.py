"""Compares a query with its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect() -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


def differences(spark, db, name: str, query, sql: str, tmp: str) -> tuple[list, list]:
    """Rows only the query has and rows only the SQL has; both over the same, sorted columns."""
    query(spark, FOLDER).write.mode("overwrite").parquet(tmp)
    db.execute(f"create or replace temp table wanted as {sql}")
    wanted = sorted(r[0] for r in db.execute("describe wanted").fetchall())
    got = sorted(r[0] for r in db.execute(f"describe select * from '{tmp}/*.parquet'").fetchall())
    assert got == wanted, f"{name}: columns {got}, in SQL {wanted}"
    columns = ", ".join(f'"{c}"' for c in wanted)
    mine, theirs = f"select {columns} from '{tmp}/*.parquet'", f"select {columns} from wanted"
    return db.execute(f"{mine} except all {theirs}").fetchmany(3), db.execute(f"{theirs} except all {mine}").fetchmany(3)
