"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Comparison: same row count, same column names, same multiset of rows
(floats rounded to 6 places, ints widened).
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return norm_value(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm_value(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    try:
        from decimal import Decimal

        if isinstance(v, Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    if hasattr(v, "asDict"):
        return norm_value(v.asDict())
    return v


def spark_kind(dt) -> str:
    name = dt.simpleString()
    return {"int": "int32", "bigint": "int64", "smallint": "int16", "tinyint": "int8", "double": "float64",
            "float": "float32", "string": "string", "boolean": "bool"}.get(name, name.split("(")[0])


def duck_kind(t: str) -> str:
    t = t.upper()
    return {"INTEGER": "int32", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8", "DOUBLE": "float64",
            "FLOAT": "float32", "VARCHAR": "string", "BOOLEAN": "bool", "HUGEINT": "int128"}.get(t, t.split("(")[0].lower())


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def check(spark, name, fn, sql, sf_dir, con):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    ts = time.time() - t
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(srows), "spark_s": round(ts, 2)}
    t = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    td = time.time() - t
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(ts, 2), "duck_s": round(td, 2)}
    if sorted(scols) != sorted(dcols):
        res.update(status="COLUMNS", spark_cols=scols, duck_cols=dcols)
        return res
    skinds = {f.name: spark_kind(f.dataType) for f in sdf.schema.fields}
    dkinds = {d[0]: duck_kind(str(d[1])) for d in cur.description}
    diff = {c: (skinds[c], dkinds[c]) for c in scols if skinds[c] != dkinds[c]}
    if diff:
        res["type_diff"] = diff
    a, b = rows_key(scols, srows), rows_key(dcols, drows)
    if a == b:
        res["status"] = "ok"
    else:
        res["status"] = "MISMATCH"
        sa, sb = set(map(repr, a)), set(map(repr, b))
        res["only_spark"] = [x[:300] for x in list(sa - sb)[:2]]
        res["only_duck"] = [x[:300] for x in list(sb - sa)[:2]]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from chunkwise.session import get_spark

    spark = get_spark()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        try:
            r = check(spark, name, qs[name], os_.get(name), sf_dir, con)
        except Exception as exc:  # report and continue
            r = {"name": name, "status": "ERROR", "error": repr(exc)[:600]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("bad:", bad, "of", len(names or qs))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
