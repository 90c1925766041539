"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql) -> list[str]:
    """Differences, empty when the results agree."""
    df = fn(spark, sf_dir)
    got_rows = df.collect()
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = rows_of(cols, rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(cols):
        return [f"columns {sorted(df.columns)} != {sorted(cols)}"]
    got = rows_of(df.columns, got_rows)
    if got != want:
        a, b = list((got - want).items()), list((want - got).items())
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}; cols {sorted(cols)}; "
            f"only spark {sum(x[1] for x in a)} {a[:2]}; only sql {sum(x[1] for x in b)} {b[:2]}")
    return problems
