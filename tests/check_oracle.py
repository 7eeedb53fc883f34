"""Run queries next to their SQL text and compare whole results.

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from stipple.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for r in pdf.itertuples(index=False):
        rows.append(tuple(
            None if v is None or v is pd.NA or v != v else (round(float(v), 6) + 0.0 if isinstance(v, float) else
                                              (int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else v))
            for v in r))
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(spark, con, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}"
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    if diff:
        return f"VALUES {len(diff)}/{len(a)} differ {diff[:2]}"
    return f"ok {len(a)}" + (f"  (types {kinds})" if kinds else "")


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(), connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            res = compare(spark, con, sf, n)
        except Exception as e:  # noqa: BLE001 - report and go on
            res = "ERROR " + str(e).strip()[:600]
        bad += not res.startswith(("ok", "rows"))
        print(f"{n:28s} {time.time() - t:6.1f}s  {res}", flush=True)
    print("failed:", bad)
