"""Run registered queries beside their SQL and compare whole results.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"no SQL; {sum(got.values())} rows"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows vs {sum(want.values())}; extra {sum(extra.values())} "
            f"{list(extra)[:3]} missing {sum(missing.values())} {list(missing)[:3]}"
        )
    return None if got else "EMPTY on both sides"


def main():
    from __spark_entry__ import oracle_sql, queries

    from hearthbook.session import local_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    sf_dir = f"/root/testdata/sf{opts.sf}"
    spark, con = local_session(8), duck(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if opts.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in opts.names):
            continue
        start = time.time()
        try:
            note = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on to the next query
            note = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(note)
        print(f"{'ok  ' if not note else 'DIFF'} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print(f"{bad} to look at")


if __name__ == "__main__":
    main()
