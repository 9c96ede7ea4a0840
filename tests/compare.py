"""Run every query on Spark and its statement on DuckDB, and compare columns, kinds, row counts and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("float", repr(v))
    if isinstance(v, (list, tuple)):
        return ("list", tuple(normal(x) for x in v))
    return (type(v).__name__, str(v))


def rows_of(rows, order):
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    got = spark_df.collect()
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(spark_df.columns) != sorted(want_cols):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_cols)}"
    names = sorted(want_cols)
    a = rows_of(got, [spark_df.columns.index(n) for n in names])
    b = rows_of(want, [want_cols.index(n) for n in names])
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, such as {names}: {bad[0][0]} != {bad[0][1]}"
    return ""


def main() -> int:
    from gravitas.session import get_spark
    import __spark_entry__ as catalog

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = get_spark(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = catalog.oracle_sql()
    failed = 0
    for name, fn in catalog.queries().items():
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            said = compare(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
            ok = not said or said.startswith("no SQL")
        except Exception as e:  # noqa: BLE001
            ok, said = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t0:6.2f}s {name} {said}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
