"""Compare a registered query with its SQL on the same parquet tables; also a command line tool.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def family(t: str) -> str:
    t = t.lower()
    for name, words in {"int": ("int", "long"), "float": ("double", "float", "decimal"), "str": ("string", "varchar"),
                        "bool": ("bool",)}.items():
        if any(w in t for w in words) and "[]" not in t and "array" not in t:
            return name
    return t


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def diff(spark, con, sf, name, fn, sql):
    """None when equal, else a short description."""
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    a = {c: family(t) for c, t in df.dtypes}
    b = {c: family(str(t)) for c, t in zip(rel.columns, rel.types)}
    if a != b:
        return f"types {a} != {b}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"{len(got)} vs {len(want)} rows; only spark {extra}; only sql {missing}"
    if not got:
        return "no rows"
    return None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or q:
        t = time.time()
        try:
            if name in o:
                d = diff(spark, con, sf, name, q[name], o[name])
            else:
                n = len(q[name](spark, sf).collect())
                d = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            d = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += d is not None
        print(f"{'ok  ' if d is None else 'FAIL'} {name} {time.time() - t:.1f}s {'' if name in o else '(no sql)'} {d or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
