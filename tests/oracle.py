"""Compares registered queries with their SQL in DuckDB, without regard to row order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

KINDS = {
    "tinyint": "BIGINT", "smallint": "BIGINT", "int": "BIGINT", "bigint": "BIGINT", "float": "DOUBLE",
    "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}
SAME = {"INTEGER": "BIGINT", "FLOAT": "DOUBLE", "SMALLINT": "BIGINT", "TINYINT": "BIGINT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return value


def compare(df, con, sql: str) -> str | None:
    """None where the two agree, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: SAME.get(str(c[1]), str(c[1])) for c in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    mine = {n: KINDS.get(k, k) for n, k in df.dtypes}
    if mine != kinds:
        return f"types {mine} vs {kinds}"
    order = sorted(names)
    theirs = Counter(tuple(_cell(r[names.index(c)]) for c in order) for r in result.fetchall())
    ours = Counter(tuple(_cell(r[c]) for c in order) for r in df.toLocalIterator())
    if ours == theirs:
        return None
    more, less = list((ours - theirs).items()), list((theirs - ours).items())
    return f"rows {sum(ours.values())} vs {sum(theirs.values())}; ours only {str(more[:2])[:600]}; theirs only {str(less[:2])[:600]}"
