"""Side by side of a query and its SQL, as sets of rows that ignore order."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

FAMILY = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "float", "float": "float", "string": "text", "boolean": "bool"}
DUCK = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(x[i]) for i in at) for x in rel.fetchall()), key=str)
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} and {len(want)} rows; only here {list(a - b)[:2]}, only there {list(b - a)[:2]}"
    types = dict(df.dtypes)
    for c in cols:
        s, d = FAMILY.get(types[c], types[c].split("(")[0]), str(rel.types[names.index(c)])
        d = DUCK.get(d, d.lower().split("(")[0])
        if s != d:
            return f"type of {c}: {types[c]} and {rel.types[names.index(c)]}"
    return ""
