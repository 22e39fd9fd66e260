"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def canonical(rows: list[dict]) -> list[tuple]:
    def plain(v: object) -> object:
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
        return v

    made = [tuple((k, plain(r[k])) for k in sorted(r)) for r in rows]
    return sorted(made, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for _, v in r])


def difference(got: list[dict], want: list[dict]) -> str | None:
    """What differs first, or None."""
    a, b = canonical(got), canonical(want)
    if a and b and [k for k, _ in a[0]] != [k for k, _ in b[0]]:
        return f"columns {[k for k, _ in a[0]]} and {[k for k, _ in b[0]]}"
    if len(a) != len(b):
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only in one: {only}"
    for x, y in zip(a, b):
        for (k, v), (_, w) in zip(x, y):
            if v != w and not (isinstance(v, float) and isinstance(w, float) and math.isclose(v, w, rel_tol=1e-7, abs_tol=2e-6)):
                return f"{k}: {v!r} and {w!r} in {x} and {y}"
    return None


def versus_sql(spark, run, sql: str, sf_dir: str) -> str | None:  # noqa: ANN001
    got = [r.asDict() for r in run(spark, sf_dir).collect()]
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return difference(got, [dict(zip(names, r)) for r in cur.fetchall()])
