"""Run registered queries against DuckDB: python tests/compare.py [sf_dir] [name-part ...]"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "<null>"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return f"{v:.9g}" if v else "0"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark, con, plan, sql: str, sf_dir: str) -> str | None:
    frame = plan(spark, sf_dir)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = canonical(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sorted(names)}\n     spark {a}\n     sql   {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from cardlens.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = build_session(master="local[8]"), duck(sf_dir)
    plans, sqls, bad = entry.queries(), entry.oracle_sql(), 0
    for name, plan in plans.items():
        if args and not any(a in name for a in args):
            continue
        began = time.time()
        try:
            if name in sqls:
                problem = differences(spark, con, plan, sqls[name], sf_dir)
            else:
                problem = None if plan(spark, sf_dir).collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '}{name:34s}{time.time() - began:6.2f}s{'' if name in sqls else '  (rows only)'}"
              f"{'' if not problem else chr(10) + '   ' + problem}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
