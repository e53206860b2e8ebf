"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v + 0.0
    if hasattr(v, "tolist"):
        return tuple(v.tolist())
    if isinstance(v, list):
        return tuple(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r)))


def differences(spark_df, con, sql):
    """None if equal, else a short description."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; first spark {got[1][:2]} first sql {want[1][:2]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}"
    return None


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from encephalake.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("oracle", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for name in wanted:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracle:
                msg = differences(df, con, oracle[name])
                n = ""
            else:
                n, msg = f"{len(df.collect())} rows", None
        except Exception as e:  # report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:1500]}", ""
        failed += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name:32s} {time.time() - t:6.1f}s {msg or n}", flush=True)
    print("failed:", failed, "of", len(wanted))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
