"""Compare a registered query with its oracle: names, row count and exact values, in any row order."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return repr(v)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf_dir: str) -> str:
    df = q.run(spark, sf_dir)
    got_cols, got = _table(df.columns, [tuple(r) for r in df.collect()])
    sql = q.oracle()
    if sql is None:
        return f"rows {len(got)}" if got else "EMPTY"
    cur = con.execute(sql)
    want_cols, want = _table([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}"
    if len(got) != len(want):
        only = [r for r in got if r not in set(want)][:2]
        return f"ROWS {len(got)} != {len(want)}; e.g. {only}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"VALUES {len(bad)}/{len(got)} differ\n   {dict(zip(got_cols, bad[0][0]))}\n   {dict(zip(got_cols, bad[0][1]))}"
    if not got:
        return "EMPTY"
    return f"ok {len(got)}"


def main():
    from tidewise.plans.catalog import load
    from tidewise.session import local_session

    registry = load()
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    def wanted(q):
        module = q.build.__module__.rsplit(".", 1)[-1]
        return not args or any(a in (q.name, module, *q.ids) for a in args)

    names = [n for n in registry if wanted(registry[n])]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            res = compare(spark, con, registry[n], sf)
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        ok = res.startswith(("ok", "rows"))
        bad += not ok
        print(f"{'' if ok else '!!! '}{n:34s} {time.time() - t:6.2f}s {res}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")


if __name__ == "__main__":
    main()
