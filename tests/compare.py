"""Run a registered query in Spark and its SQL twin in DuckDB and compare values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(v + 0.0))
    return (1, str(v))


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: [_key(v) for v in t])


def oracle_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    idx = [cols.index(n) for n in names]
    return names, sorted((tuple(r[i] for i in idx) for r in cur.fetchall()), key=lambda t: [_key(v) for v in t])


def diff(a, b):
    """None when equal, else a short description."""
    (na, ra), (nb, rb) = a, b
    if na != nb:
        return f"columns {na} vs {nb}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} vs {len(rb)}; {ra[:2]} vs {rb[:2]}"
    bad = []
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if type(u) is not type(v) and u is not None and v is not None:
                return f"types {type(u)} vs {type(v)} in {dict(zip(na, x))} vs {dict(zip(na, y))}"
            if (isinstance(u, float) and math.isnan(u)) or (isinstance(v, float) and math.isnan(v)):
                return f"nan in {dict(zip(na, x))} vs {dict(zip(na, y))}"
        if [_key(u) for u in x] != [_key(v) for v in y]:
            bad.append((x, y))
    if bad:
        return f"{len(bad)} of {len(ra)} rows differ; columns {na}; first {bad[0]}"
    return None
