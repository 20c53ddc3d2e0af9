"""Run registered queries next to their SQL twins: ``python tests/compare.py [names...]``."""
from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(t: str) -> str:
    t = t.lower()
    for names, k in ((("bigint", "int", "long", "hugeint", "smallint", "integer"), "int"),
                     (("double", "float", "decimal"), "num"), (("timestamp",), "ts"), (("date",), "date"),
                     (("bool",), "bool"), (("string", "varchar"), "str")):
        if t.startswith(names):
            return k
    return t


def compare(spark, sf: str, name: str, fn, sql: str | None, con) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    cols = df.columns
    if sql is None:
        return len(rows) > 0, f"rows-only {len(rows)} {took:.1f}s"
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    dtypes = {d[0]: str(d[1]) for d in rel.description}
    drows = rel.fetchall()
    if sorted(cols) != sorted(dcols):
        return False, f"columns {sorted(cols)} != {sorted(dcols)}"
    bad_types = [(c, t, dtypes[c]) for c, t in df.dtypes if kind(t) != kind(dtypes[c])]
    order = sorted(cols)
    a = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(norm(r[dcols.index(c)]) for c in order) for r in drows), key=repr)
    void = [c for i, c in enumerate(order) if a and all(r[i] is None for r in a)]
    note = f"{len(a)} rows {took:.1f}s" + (f" ALL-NULL {void}" if void else "") + (f" TYPES {bad_types}" if bad_types else "")
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)} {note}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return False, f"{len(diff)} of {len(a)} differ, cols {order}: {diff[0]} {note}"
    return (len(a) > 0), note if a else f"EMPTY {note}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tapeworks.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf, argv = argv[0], argv[1:]
    spark = local_session(8)
    con = duck(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    picked = [n for n, f in queries.items() if not argv or n in argv or f.__module__.split(".")[-1] in argv]
    failed = []
    for n in picked:
        try:
            ok, note = compare(spark, sf, n, queries[n], sql.get(n), con)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(("ok   " if ok else "FAIL ") + n + "  " + note, flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(picked) - len(failed)}/{len(picked)} ok; failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
