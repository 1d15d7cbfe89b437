"""Side-by-side comparison of a registered query and its SQL twin."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


# SQL type -> the Spark types that hold the same values.
TYPES = {"BIGINT": {"bigint"}, "INTEGER": {"int"}, "DOUBLE": {"double"}, "VARCHAR": {"string"}, "BOOLEAN": {"boolean"},
         "TIMESTAMP": {"timestamp", "timestamp_ntz"}}


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(normal(v) for v in value.values())
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(spark, con, query, sql, sf_dir) -> list[str]:
    df = query(spark, sf_dir)
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want_names, want = table([d[0] for d in cursor.description], cursor.fetchall())
    out = []
    if got_names != want_names:
        out.append(f"columns {got_names} != {want_names}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    wrong = [(c, t, kinds.get(c)) for c, t in df.dtypes if t not in TYPES.get(kinds.get(c), set())]
    if wrong:
        out.append(f"types {wrong}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[:2]}")
    return out
