"""Side-by-side check of a Spark query and its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(table: pa.Table) -> tuple[dict, list]:
    names = sorted(table.column_names)
    kinds = {n: str(table.schema.field(n).type).replace("large_", "") for n in names}
    rows = list(zip(*[table.column(n).to_pylist() for n in names])) if names else []
    return kinds, sorted(map(repr, rows))


def differences(spark_df, con, sql: str) -> list[str]:
    ours, ours_rows = _rows(spark_df.toArrow())
    twin = con.execute(sql).to_arrow_table()
    theirs, their_rows = _rows(twin)
    found = []
    if ours != theirs:
        found.append(f"schema {ours} vs {theirs}")
    if not ours_rows:
        found.append("no rows")
    if len(ours_rows) != len(their_rows):
        found.append(f"{len(ours_rows)} vs {len(their_rows)} rows")
    if ours_rows != their_rows:
        a, b = set(ours_rows), set(their_rows)
        found.append(f"only ours {len(a - b)}: {sorted(a - b)[:3]} / only twin {len(b - a)}: "
                     f"{sorted(b - a)[:3]}")
    return found
