"""Compare registered queries with their DuckDB checks."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(plain(v) for v in r) for r in df.select(*cols).collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]


def key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def difference(df, con, sql):
    """None when equal, else a short account of the difference."""
    c1, r1 = spark_rows(df)
    c2, r2 = duck_rows(con, sql)
    if c1 != c2:
        return f"columns {c1} vs {c2}"
    r1.sort(key=key)
    r2.sort(key=key)
    if r1 == r2:
        return None
    s1, s2 = set(r1), set(r2)
    a, b = sorted(s1 - s2, key=key)[:2], sorted(s2 - s1, key=key)[:2]
    return f"{c1}\n  rows {len(r1)} vs {len(r2)}, only spark {len(s1 - s2)}: {a}\n  only sql {len(s2 - s1)}: {b}"


def main(folder, names):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from shockspan.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    checks = e.oracle_sql()
    for n in names or e.queries():
        t0 = time.time()
        try:
            df = e.queries()[n](spark, folder)
            if n in checks:
                got = difference(df, con, checks[n])
            else:
                got = None
            rows = None if n in checks else len(df.collect())
            note = "" if rows is None else f" (rows only: {rows})"
        except Exception as x:  # noqa: BLE001
            got, note = f"{type(x).__name__}: {str(x)[:1500]}", ""
        bad += got is not None
        print(f"{'ok  ' if got is None else 'FAIL'} {n} {time.time() - t0:.1f}s{note}" + (f"\n  {got}" if got else ""), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
