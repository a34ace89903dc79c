"""Compare a Spark result with the result of DuckDB on the same tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (value + 0.0 if value else 0.0)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types and values (empty when equal)."""
    rel = con.sql(sql)
    names, other = sorted(df.columns), sorted(rel.columns)
    if names != other:
        return [f"columns {names} != {other}"]
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    problems = [
        f"type of {c}: {t} != {kinds[c]}" for c, t in df.dtypes if KINDS.get(t, t) != kinds[c]
    ]
    spark_rows = [tuple(_plain(r[c]) for c in names) for r in df.select(*names).collect()]
    order = [rel.columns.index(c) for c in names]
    duck_rows = [tuple(_plain(r[i]) for i in order) for r in rel.fetchall()]
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    left, right = Counter(spark_rows), Counter(duck_rows)
    if left != right:
        only_left, only_right = left - right, right - left
        problems.append(
            f"{only_left.total()} rows differ of {len(spark_rows)}; e.g. spark {sorted(only_left, key=repr)[:2]} duck "
            f"{sorted(only_right, key=repr)[:2]} columns {names}"
        )
    return problems
