"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_norm(x)) for x in v) + "]"
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    return None if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return "rows-only", f"{len(got)} rows", t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    a_names, a = rows_of(df.columns, [tuple(r) for r in got])
    b_names, b = rows_of(names, want)
    if a_names != b_names:
        return "COLUMNS", f"{a_names} vs {b_names}", t1 - t0, t2 - t1
    if a != b:
        return (
            "DIFF",
            f"{sum(a.values())} vs {sum(b.values())} rows {a_names}\n   spark only {list((a - b).items())[:3]}\n   sql only   {list((b - a).items())[:3]}",
            t1 - t0,
            t2 - t1,
        )
    types = [t for _, t in df.dtypes]
    note = "" if got else " EMPTY"
    return "ok", f"{len(got)} rows{note} {types if note else ''}", t1 - t0, t2 - t1


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from marketloom.session import local_session

    sf = argv[0]
    wanted = argv[1:]
    spark = local_session()
    sf_dir = f"/root/testdata/{sf}"
    con = duck(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            status, note, ts, td = compare(spark, con, sf_dir, name, fn, os_.get(name))
        except Exception as e:  # report and go on to the next query
            status, note, ts, td = "ERROR", f"{type(e).__name__}: {str(e)[:700]}", 0.0, 0.0
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{name:10s} {status:10s} spark {ts:5.1f}s sql {td:5.1f}s {note}", flush=True)
        spark.catalog.clearCache()
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
