"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def difference(df, con, sql: str) -> str:
    """What differs, or an empty string."""
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    at = [columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}; columns {names}"
