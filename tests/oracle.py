"""Run registered queries against DuckDB and compare rows, columns, types and values.

    python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

FAMILIES = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float",
            "string": "text", "boolean": "bool", "timestamp": "time", "date": "date"}
DUCK = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "UBIGINT": "huge", "DOUBLE": "float", "FLOAT": "float",
        "VARCHAR": "text", "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date"}


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(spark, con, name, fn, text, folder):
    """None when equal, else a short description."""
    df = fn(spark, folder)
    types = dict(df.dtypes)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not text:
        return None if got else "no rows"
    res = con.execute(text)
    columns = [d[0] for d in res.description]
    duck_types = {d[0]: str(d[1]) for d in res.description}
    want = rows_of(columns, res.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    bad = [(c, types[c], duck_types[c]) for c in columns if FAMILIES.get(types[c], types[c]) != DUCK.get(duck_types[c], duck_types[c])]
    if bad:
        return f"types {bad}"
    if not want:
        return "oracle has no rows"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, e.g. {diff[0][0]} != {diff[0][1]} (columns {sorted(columns)})"
    return None


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from tallyforge.queries import REGISTRY
    from tallyforge.session import local_session

    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(8), connect(folder)
    failed = 0
    for name, (fn, text) in REGISTRY.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, text, folder)
        except Exception as exc:  # report every query, not only the first failure
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += problem is not None
        kind = "sql" if text else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed", flush=True)


if __name__ == "__main__":
    main()
