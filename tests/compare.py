"""Run registered queries next to their SQL and compare all rows."""

from __future__ import annotations

import math
import sys
import time

import os

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyhound.plans import derive  # noqa: E402
from tallyhound.plans.catalogue import ORACLES, QUERIES


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in derive._TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "is_finite"):
        return round(float(value), 6)
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
                 "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if name not in ORACLES:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.2f}s"
    cursor = con.execute(ORACLES[name])
    want = cursor.fetchall()
    types = {d[0]: str(d[1]) for d in cursor.description}
    a, ca = _rows(df.columns, [tuple(r) for r in got])
    b, cb = _rows([d[0] for d in cursor.description], want)
    if ca != cb:
        return False, f"{name}: columns {ca} and {cb}"
    wrong = [(c, t, types[c]) for c, t in df.dtypes if SPARK_TO_DUCK.get(t, t.upper()) != types[c]]
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return False, (f"{name}: {len(a)} rows, SQL {len(b)} rows; columns {ca}\n  only here {sorted(sa - sb)[:4]}"
                       f"\n  only SQL {sorted(sb - sa)[:4]}")
    if wrong:
        return False, f"{name}: values agree, types differ {wrong}"
    return True, f"{name}: {len(a)} rows agree, {took:.2f}s"


if __name__ == "__main__":
    from tallyhound.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    names = [q for q in QUERIES if any(q.startswith(n) for n in names)]
    spark = build_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    for n in names:
        try:
            ok, text = compare(spark, con, sf, n)
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{n}: {type(error).__name__} {str(error)[:1500]}"
        print("OK  " if ok else "FAIL", text, flush=True)
