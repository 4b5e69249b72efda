"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _kind(type_name: str) -> str:
    return {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}.get(type_name, type_name)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(made, key=repr)


def compare(spark, con, query, sql, sf_dir):
    """Return None where both agree in names, types and rows, else what differs."""
    frame = query(spark, sf_dir)
    kinds = sorted((n, _kind(t)) for n, t in frame.dtypes)
    names, mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    described = sorted((d[0], str(d[1])) for d in cursor.description)
    sql_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != sql_names:
        return f"columns {names} against {sql_names}"
    if kinds != described:
        return f"types {kinds} against {described}"
    if mine != theirs:
        first = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
        return f"{len(mine)} rows against {len(theirs)}; first difference {first}"
    return None
