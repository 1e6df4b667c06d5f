"""Run a registered query in Spark and its SQL in DuckDB; compare rows order-insensitively."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from seqforge.plans.fixtures import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def type_mismatches(sdf, cur) -> list:
    """Columns whose Spark type does not map to the DuckDB result type."""
    duck_types = {d[0]: str(d[1]).upper() for d in cur.description}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        got = duck_types.get(f.name, "?")
        if want != got:
            out.append((f.name, f.dataType.simpleString(), got))
    return out


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    from seqforge.plans import catalog  # noqa: F401  (registers queries)
    from seqforge.plans.registry import REGISTRY
    e = REGISTRY[name]
    t0 = time.time()
    df = e.fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if e.sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    cur = con.execute(e.sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={sorted(scols)} duck={sorted(dcols)}"
        return res
    a, b = _rows(scols, srows), _rows(dcols, drows)
    tm = type_mismatches(df, cur)
    if a == b and tm:
        res["status"] = f"TYPES {tm}"
    elif a == b:
        res["status"] = "ok"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"MISMATCH rows {len(a)} vs {len(b)}; first diffs {diff}"
    return res


if __name__ == "__main__":
    from seqforge.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", 8)
    from seqforge.plans import catalog  # noqa: F401
    from seqforge.plans.registry import REGISTRY
    con = duck(sf)
    bad = 0
    for n in names or list(REGISTRY):
        try:
            r = compare(spark, n, sf, con)
        except Exception as ex:  # noqa: BLE001
            r = {"name": n, "status": f"ERROR {type(ex).__name__}: {str(ex)[:600]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("BAD", bad)
