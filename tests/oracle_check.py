"""Run named queries in Spark and their DuckDB twins, compare rows.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: match / mismatch with counts.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    ddf = con.execute(sql).df() if sql else None
    if ddf is None:
        return f"{name:32s} rows={len(sdf):7d} (rows-only) spark={t1 - t0:.2f}s"
    scols, srows = rows_of(sdf)
    dcols, drows = rows_of(ddf)
    ok = scols == dcols and srows == drows
    msg = "MATCH" if ok else "MISMATCH"
    extra = ""
    if not ok:
        if scols != dcols:
            extra = f" cols spark={scols} duck={dcols}"
        else:
            dset, sset = set(drows), set(srows)
            diff_s = [r for r in srows if r not in dset][:3]
            diff_d = [r for r in drows if r not in sset][:3]
            extra = f" spark_only={diff_s} duck_only={diff_d}"
    return f"{name:32s} {msg} rows spark={len(srows)} duck={len(drows)} spark={t1 - t0:.2f}s{extra}"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from tessera.session import build_session
    import __spark_entry__ as ent
    spark = build_session("local[8]", 8)
    qs, orc = ent.queries(), ent.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        try:
            line = compare(spark, con, sf_dir, name, qs[name], orc.get(name))
        except Exception as exc:  # report and continue
            line = f"{name:32s} ERROR {type(exc).__name__}: {str(exc)[:300]}"
        if "MATCH" not in line.split()[1:2] and "rows-only" not in line:
            bad += 1
        print(line, flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
