"""Compare every registered query with its SQL on the same tables.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def _kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(dtype.kind, "object")


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = _canonical(got), _canonical(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if _kind(a.dtype) != _kind(b.dtype):
            return f"{c}: type {a.dtype} != {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}: {int((~same).sum())} values, e.g. {got.loc[i].to_dict()} != {want.loc[i].to_dict()}"
    return None


def run(spark, sf: str, names: list[str] | None = None) -> dict[str, str | None]:
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    con, out = connect(sf), {}
    for name in names or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            t1 = time.time()
            if name in oracles:
                out[name] = differences(got, con.execute(oracles[name]).df())
            else:
                out[name] = None if len(got) else "no rows"
        except Exception as e:                    # report and go on with the next query
            t1 = time.time()
            got, out[name] = [], f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if out[name] is None else 'FAIL'} {name:24s} rows={len(got):7d} spark={t1 - t:6.2f}s "
              f"sql={time.time() - t1:6.2f}s {'' if name in oracles else '(rows only)'} {out[name] or ''}", flush=True)
    return out


if __name__ == "__main__":
    from tracewright.session import get_session
    spark = get_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                 "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    bad = {k: v for k, v in run(spark, sf, sys.argv[2:] or None).items() if v}
    print(f"{len(bad)} failures: {sorted(bad)}")
