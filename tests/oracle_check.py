"""Run registered queries against their SQL: python tests/oracle_check.py [sf] [key ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, list):
        return str([normal(v) for v in value])
    return str(value)


def sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark_df, con, sql: str) -> str | None:
    """None when the two tables agree, else what differs."""
    names = sorted(spark_df.columns)
    got = sorted((tuple(normal(r[n]) for n in names) for r in spark_df.collect()), key=sort_key)
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns: {names} != {sorted(found)}"
    order = [found.index(n) for n in names]
    want = sorted((tuple(normal(r[i]) for i in order) for r in cursor.fetchall()), key=sort_key)
    if len(got) != len(want):
        return f"rows: {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if not all(same(x, y) for x, y in zip(a, b)):
            return f"{names}\n    spark {a}\n    sql   {b}"
    return None


def main() -> int:
    from tallybook.plans import catalogue
    from tallybook.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    keys = sys.argv[2:] or list(catalogue.QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for key in keys:
        start = time.time()
        try:
            df = catalogue.QUERIES[key](spark, sf_dir)
            sql = catalogue.ORACLES.get(key)
            problem = compare(df, con, sql) if sql else f"rows only: {df.count()}"
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1500]
        ok = problem is None or problem.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
