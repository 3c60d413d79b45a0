"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py SF [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    return repr(float(f"{value:.9g}")) if isinstance(value, float) else repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, f"{sum(got.values())} rows, no SQL twin"
    rel = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} against {want_cols}"
    if got == want:
        return bool(got), f"{sum(got.values())} rows"
    extra, lost = got - want, want - got
    return False, f"{sum(got.values())} against {sum(want.values())} rows; only here {list(extra)[:3]}; only in SQL {list(lost)[:3]}"


def main(argv):
    import __spark_entry__ as entry
    from docprep.session import local_session

    spark = local_session("oracle_check", "8")
    folder = f"/root/testdata/sf{argv[1]}"
    con = duck(folder)
    names = argv[2:]
    sql = entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            ok, text = compare(spark, con, folder, query, sql.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {name:34s} {time.time() - start:6.2f}s  {text[:1800]}", flush=True)
        if ok is False:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
