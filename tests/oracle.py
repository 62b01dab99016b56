"""Compare a Spark query with its DuckDB SQL: column names, kinds of types, row
count, and an order-insensitive multiset of values.  Doubles must agree in ten
significant digits (or in 9 decimals, for numbers around zero)."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if abs(v) < 5e-10 else float(f"{v:.9e}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def _kind(v):
    return type(_norm(v)).__name__ if not isinstance(v, bool) else "bool"


def _kinds(cols, records):
    """The kinds of values of each column (bool, int, float, str, ...)."""
    out = {c: set() for c in cols}
    for r in records:
        for c, v in zip(cols, r, strict=True):
            if v is not None:
                out[c].add(_kind(v))
    return out


def compare(spark_df, con, sql):
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={sorted(s_cols)} duckdb={sorted(d_cols)}")
        return problems
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duckdb={len(d_rows)}")
    s_kinds, d_kinds = _kinds(s_cols, s_rows), _kinds(d_cols, d_rows)
    kinds = {c: (s_kinds[c], d_kinds[c]) for c in s_cols
             if {"Decimal": "float"}.get(min(d_kinds[c], default=""), min(d_kinds[c], default="")) != min(s_kinds[c], default="")}
    if kinds:
        problems.append(f"types differ: {kinds}")
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diff = [x for x in a if x not in set(b)][:3]
        diff2 = [x for x in b if x not in set(a)][:3]
        problems.append(f"values differ; spark-only {diff} duckdb-only {diff2}")
    return problems
