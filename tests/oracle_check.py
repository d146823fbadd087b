"""Run registered jobs on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [job ...]
Mirrors the driver's check: row count, column names, and order-insensitive
values (floats compared exactly and, separately, to 1e-9 relative).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from rightsize.sources.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, exact: bool):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if exact else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(_norm(x, exact) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, exact)) for k, x in v.items()))
    if isinstance(v, list):
        return tuple(_norm(x, exact) for x in v)
    return v


def rows_key(rows, exact):
    return sorted((tuple(_norm(v, exact) for v in r) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = sdf.select(*cols).collect()
    t1 = time.time()
    if sql is None:
        return {"job": name, "rows": len(srows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    rel = con.sql(sql)
    dcols = rel.columns
    drows = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in sorted(dcols))} FROM ({sql})").fetchall()
    types_s = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    types_d = dict(zip(rel.columns, [str(t) for t in rel.types]))
    res = {"job": name, "rows": len(srows), "oracle_rows": len(drows),
           "cols_match": cols == sorted(dcols), "spark_s": round(t1 - t0, 2)}
    if res["cols_match"]:
        res["exact"] = rows_key(srows, True) == rows_key(drows, True)
        res["approx"] = res["exact"] or rows_key(srows, False) == rows_key(drows, False)
    else:
        res["spark_cols"], res["oracle_cols"] = cols, sorted(dcols)
    res["types"] = {c: (types_s.get(c), types_d.get(c)) for c in cols}
    return res


def main():
    from rightsize.session import local_session
    import __spark_entry__ as E
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session()
    con = duck(sf_dir)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in q.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, con, name, fn, o.get(name), sf_dir)
        except Exception as exc:  # report and continue
            r = {"job": name, "error": repr(exc)[:600]}
        ok = r.get("exact") or (r.get("oracle") is None and "error" not in r and "oracle_rows" not in r)
        if not ok:
            bad += 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} bad of {len(q) if not only else len(only)}")


if __name__ == "__main__":
    main()
