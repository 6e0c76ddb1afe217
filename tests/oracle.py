"""Runs a registered query and its SQL side by side."""

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value.is_integer() and abs(value) < 2**53 else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(frame, con, sql):
    """None if both hold the same rows, else what differs."""
    got_columns, got = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_columns, want = rows_of(names, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} and {want_columns}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want))[:3]}; only SQL {list((want - got))[:3]}"
    return None
