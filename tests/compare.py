"""Run registered plans next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, "/root/repo")
from lumenframe.sources.tables import TABLES  # noqa: E402


def oracle_connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) if abs(v) < 1e6 else float(f"{v:.12g}")
    if isinstance(v, int):
        return float(v)
    if v is pd.NaT:
        return None
    return str(v)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, build, sql, folder) -> str:
    """Empty string if equal, else what differs."""
    df = build(spark, folder)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} sql {want[:2]}"
    for a, b in zip(got, want):
        if a != b and not all(_near(x, y) for x, y in zip(a, b)):
            return f"cols {got_cols}\n spark {a}\n sql   {b}"
    return ""


def _near(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return x == y or abs(x - y) <= 1e-9 * max(abs(x), abs(y))
    if isinstance(x, tuple) and isinstance(y, tuple) and len(x) == len(y):
        return all(_near(a, b) for a, b in zip(x, y))
    return x == y


def main(names, folder):
    import __spark_entry__ as entry
    from lumenframe.session import local_session

    spark = local_session()
    if os.environ.get("HOT"):  # pretend that small keys are hot: every ordered operator takes its split path
        spark.conf.set("lumenframe.hotRows", os.environ["HOT"])
        spark.conf.set("lumenframe.exactValues", "5")
    con = oracle_connection(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    picked = [q for q in queries if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    bad = 0
    for q in picked:
        t = time.time()
        try:
            if q in sqls:
                msg = compare(spark, con, queries[q], sqls[q], folder)
                tag = "ok  " if not msg else "DIFF"
            else:
                n = len(queries[q](spark, folder).collect())
                msg, tag = ("" if n else "no rows"), f"rows={n}"
        except Exception as e:  # report and go on
            msg, tag = str(e)[:600], "FAIL"
        bad += bool(msg)
        if msg or os.environ.get("SHOW") or time.time() - t > 4:
            print(f"{tag} {q} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"{len(picked)} run, {bad} bad")


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        folder = args.pop(0)
    main(args, folder)
