"""Run registered queries next to their SQL twins and report differences.

usage: python oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from turnspark.queries import REGISTRY, SQL, load_all

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value + 0.0, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def check(spark, con, sf_dir: str, name: str) -> tuple[str, float]:
    start = time.time()
    df = REGISTRY[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if name not in SQL:
        return f"rows only: {len(rows)}", took
    cursor = con.execute(SQL[name])
    want_columns = [d[0] for d in cursor.description]
    want = table_of(want_columns, cursor.fetchall())
    got = table_of(df.columns, rows)
    if got[0] != want[0]:
        return f"COLUMNS differ: {got[0]} / {want[0]}", took
    if len(got[1]) != len(want[1]):
        return f"ROWS differ: {len(got[1])} / {len(want[1])}", took
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"VALUES differ in {len(bad)} of {len(want[1])}: {bad[0]}", took
    return f"ok: {len(rows)}", took


def main() -> int:
    from bench import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    names = sys.argv[2:] or sorted(REGISTRY)
    spark = session()
    con = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            result, took = check(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            result, took = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0
        ok = result.startswith(("ok", "rows only"))
        failed += not ok
        print(f"{name:36s} {took:6.2f}s  {result}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
