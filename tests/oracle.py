"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def differences(df, con, sql):
    """What differs, or an empty string."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    want = rows_of(names, found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} for {sorted(names)}"
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if k in KINDS and kinds[c].upper() not in (KINDS[k], "NUMBER", "STRING", "BOOL", "DATETIME") and KINDS[k] != kinds[c]}
    if odd:
        return f"types {odd}"
    if got != want:
        return f"{len(got)} rows for {len(want)}: {[x for x in zip(got, want, strict=False) if x[0] != x[1]][:2]}"
    return ""
