"""Comparing a registered query with its oracle SQL in DuckDB, order aside."""

from __future__ import annotations

import math

import duckdb

from assay.plans.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((c is None, str(c)) for c in r))


def compare(spark, con, name, queries, oracles, sf_dir):
    """None when a query and its oracle agree, else what differs."""
    df = queries[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if name not in oracles:
        return None if got is not None else "no rows"
    rel = con.sql(oracles[name])
    want = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [
        f"{c}: {kinds[c]} / {t}"
        for c, t in zip(rel.columns, map(str, rel.types), strict=True)
        if same.get(kinds[c]) != t and t != "NULL" and t != '"NULL"'
    ]
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}: {got[:3]} / {want[:3]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} != {b}"
    if odd:
        return f"types {odd}"
    return None
