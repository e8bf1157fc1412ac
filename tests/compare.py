"""Spark result and oracle SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def differences(spark, sf_dir: str, query, sql: str):
    """Columns that differ, and rows on one side only."""
    df = query(spark, sf_dir)
    con = database(sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    columns = sorted(df.columns)
    if columns != sorted(names):
        return {"spark": columns, "sql": sorted(names)}
    at = [names.index(x) for x in columns]
    a = sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
    if a == b:
        return None
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return {"rows": (len(a), len(b)), "only spark": sorted(sa - sb)[:3], "only sql": sorted(sb - sa)[:3]}
