"""Compare registered queries with their SQL twins: ``python check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


TIMES: list[float] = []


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return str(v)


def _kind(v) -> str:
    return type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, sql: str, con) -> str | None:
    """None if equal, else what differs."""
    began = time.perf_counter()
    found = df.collect()
    middle = time.perf_counter()
    rel = con.sql(sql)
    want = rel.fetchall()
    TIMES[:] = [middle - began, time.perf_counter() - middle]
    cols, mine = rows_of(df.columns, [tuple(r) for r in found])
    ocols, theirs = rows_of(rel.columns, want)
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}"
    kinds = {c: _kind(found[0][c]) for c in df.columns} if found else {}
    okinds = {c: _kind(v) for c, v in zip(rel.columns, want[0])} if want else {}
    off = {c: (kinds[c], okinds[c]) for c in kinds if kinds[c] != okinds[c] and "NoneType" not in (kinds[c], okinds[c])}
    return f"types differ {off}" if off else None


def main() -> int:
    from tasteloom.registry import QUERIES, oracles
    from tasteloom.session import drop_stored, local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names, sqls = sys.argv[2:] or list(QUERIES), oracles()
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        began = time.perf_counter()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in sqls:
                problem = compare(df, sqls[name], con)
                note = f"{TIMES[0]:.1f}s collect, {TIMES[1]:.1f}s sql" if problem is None else problem
            else:
                problem, note = None, f"{df.count()} rows (no SQL)"
        except Exception as e:  # report and go on to the next query
            problem = note = f"{type(e).__name__}: {str(e)[:1500]}"
        drop_stored(spark)
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.perf_counter() - began:.1f}s {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
