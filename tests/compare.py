"""Run named queries next to their SQL and compare rows, columns and values."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


_KINDS = {
    "VARCHAR": "string", "DOUBLE": "double", "BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "BOOLEAN": "boolean",
}


def _sorted_rows(rows):
    return sorted(rows, key=lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row))


def mismatch(frame, con, sql: str) -> str | None:
    """What differs between a DataFrame and a SQL result; ``None`` if nothing does."""
    names = sorted(frame.columns)
    result = con.execute(sql)
    found = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    if sorted(found) != names:
        return f"columns {names} against {sorted(found)}"
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    if types != found:
        return "types " + ", ".join(f"{n}: {types[n]} against {found[n]}" for n in names if types[n] != found[n])
    order = [list(found).index(n) for n in names]
    theirs = _sorted_rows([tuple(row[i] for i in order) for row in result.fetchall()])
    ours = _sorted_rows([tuple(row[n] for n in names) for row in frame.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, first {different[0]} ({names})"
    return None
