"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, sql: str, db: duckdb.DuckDBPyConnection) -> list[str]:
    """Empty when both sides have the same columns and the same rows."""
    found = df.collect()
    result = db.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    expected = result.fetchall()
    ours, theirs = _rows(df.columns, found), _rows(names, expected)
    if ours == theirs:
        return []
    only_ours, only_theirs = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return [f"rows {len(found)} / {len(expected)}", f"only spark: {only_ours}", f"only sql: {only_theirs}"]
