"""Runs registered queries in Spark and DuckDB and compares the rows.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6f}"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} sql {sorted(names)}"
    want = _sorted_rows(names, cur.fetchall())
    if not got and not want:
        return "both empty"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return (
            f"rows spark={len(got)} sql={len(want)}; columns {sorted(names)}\n"
            f"   spark only: {sorted(a - b)[:2]}\n   sql only:   {sorted(b - a)[:2]}"
        )
    return None


def main(argv: list[str]) -> int:
    from vigilake.plans import ORACLES, QUERIES
    from vigilake.session import local_session

    sf = argv[0] if argv else "0.001"
    wanted = argv[1:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        took = time.time() - start
        label = "ok " if problem is None else "BAD"
        failed += problem is not None
        print(f"{label} {took:6.2f}s {name}{'' if name in ORACLES else ' (rows only)'}", problem or "", flush=True)
    print(f"{len(wanted) - failed} ok, {failed} bad")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
