"""Run a registered query and its SQL counterpart and compare names, types and values."""

from __future__ import annotations

import math

import duckdb

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _sortable(row):
    return tuple((value is not None, str(type(value).__name__), value if value is not None else 0) for value in row)


def _plain(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=_sortable)


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, sql: str, con) -> list[str]:
    answer = con.execute(sql)
    types = {c[0]: str(c[1]) for c in answer.description}
    want_columns, want = table(list(types), answer.fetchall())
    got_columns, got = table(df.columns, df.collect())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    problems = []
    for field in df.schema:
        kind = field.dataType.simpleString()
        if SAME_TYPE.get(kind, kind) != types[field.name]:
            problems.append(f"{field.name}: {kind} != {types[field.name]}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return problems
