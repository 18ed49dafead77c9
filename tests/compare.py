"""Local twin of the driver's correctness gate: Spark report vs DuckDB oracle."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, key, build, sql, sf_dir):
    t0 = time.time()
    df = build(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return {"key": key, "status": "rows-only", "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    t2 = time.time()
    info = {"key": key, "rows": (len(s_rows), len(o_rows)), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if sorted(s_cols) != sorted(o_cols):
        info["status"] = "SCHEMA"
        info["cols"] = (s_cols, o_cols)
        return info
    a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
    if a == b:
        info["status"] = "OK"
    else:
        info["status"] = "VALUES"
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        info["cols"] = sorted(s_cols)
        info["diff"] = diffs
    return info


def main(argv):
    from duck import connect
    from marketlens.session import get_session
    import __spark_entry__ as E

    sf_dir = "/root/testdata/sf0.01"
    keys = argv[1:]
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for key in (keys or sorted(qs)):
        if keys and key not in qs:
            matches = [k for k in qs if k.startswith(key)]
        else:
            matches = [key]
        for k in matches:
            try:
                info = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
            except Exception as e:  # report and continue
                info = {"key": k, "status": "ERROR", "err": str(e)[:600]}
            if info["status"] not in ("OK", "rows-only"):
                bad += 1
            print(info, flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main(sys.argv)
