"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PLAIN = {"BIGINT", "VARCHAR", "BOOLEAN", "DOUBLE", "FLOAT", "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf):
    """Rows as sorted text tuples, columns in name order."""
    pdf = pdf[sorted(pdf.columns)]
    cols = []
    for c in pdf.columns:
        s = pdf[c]
        if s.dtype.kind == "f":
            cols.append(["null" if x != x else (str(int(x)) if float(x).is_integer() else f"{x:.6f}") for x in s])
        else:
            gone = s.isna()
            cols.append(["null" if g else (str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)) for x, g in zip(s, gone)])
    return sorted(zip(*cols)) if cols else []


def check(spark, con, name, build, sql, sf_dir):
    t = time.time()
    got = build(spark, sf_dir)
    gp = got.toPandas()
    spent = time.time() - t
    if sql is None:
        return None, len(gp), spent, ""
    t = time.time()
    want = con.execute(sql).df()
    # An INTEGER must stand for an int column, as a result with fixed types may ask for; all others are widened.
    small = {name for name, kind in got.dtypes if kind == "int"}
    typed = [(d[0], str(d[1])) for d in con.execute(f"DESCRIBE {sql}").fetchall()]
    odd = [(name, kind) for name, kind in typed if kind not in PLAIN and not (kind == "INTEGER" and name in small)]
    if sorted(gp.columns) != sorted(want.columns):
        return False, len(gp), spent, f"columns {sorted(gp.columns)} vs {sorted(want.columns)}"
    a, b = canonical(gp), canonical(want)
    note = f"odd types {odd}" if odd else ""
    if a != b:
        sa, sb = set(a), set(b)
        note += f" rows {len(a)} vs {len(b)} cols {sorted(gp.columns)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"
    return a == b and not odd, len(gp), spent, note + ("" if time.time() - t < 20 else f" slow sql {time.time() - t:.0f}s")


def main(argv):
    import importlib

    from shardlens.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    entry = importlib.import_module("__spark_entry__")
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for n in names:
        try:
            ok, rows, spent, note = check(spark, con, n, queries[n], oracles.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001 - a report tool: name the failure and go on
            ok, rows, spent, note = False, -1, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], n, rows, f"{spent:.1f}s", note, flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
