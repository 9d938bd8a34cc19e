"""Runs a registered query and its SQL side by side: ``python -m tests.compare [names]``."""

from __future__ import annotations

import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, list):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _cell(v[k])) for k in sorted(v))
    return v


def rows_of(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_cell(v) for v in r) for r in zip(*cols)]
    return names, sorted(rows, key=repr)


def compare(spark, name: str, sf_dir: str, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    got = entry.queries()[name](spark, sf_dir).toArrow()
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {got.num_rows} ({t1 - t0:.2f}s)"
    want = con.execute(sql).to_arrow_table()
    t2 = time.time()
    timing = f"(spark {t1 - t0:.2f}s, duckdb {t2 - t1:.2f}s)"
    gn, g = rows_of(got)
    wn, w = rows_of(want)
    if gn != wn:
        return False, f"columns {gn} != {wn}"
    types = [
        (n, str(got.schema.field(n).type), str(want.schema.field(n).type))
        for n in gn
        if str(got.schema.field(n).type).replace("large_", "")
        != str(want.schema.field(n).type).replace("large_", "")
    ]
    if g != w:
        only_g = [r for r in g if r not in set(w)][:3] if len(g) < 20000 else []
        only_w = [r for r in w if r not in set(g)][:3] if len(w) < 20000 else []
        return False, f"{len(g)} vs {len(w)} rows {timing}\n  spark {only_g}\n  sql   {only_w}"
    return True, f"{len(g)} rows {timing}" + (f" TYPES {types}" if types else "")


if __name__ == "__main__":
    from manualdex.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    names = args or list(entry.queries())
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            ok, detail = compare(spark, n, sf, con)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, detail = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, detail, flush=True)
    print("failures:", bad)
