"""Run registered queries in Spark and their SQL twins in DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query and exits non-zero on any mismatch.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if not isinstance(v, (list, tuple)) and not hasattr(v, "tolist"):
        try:
            if pd.isna(v):
                return None
        except (TypeError, ValueError):
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(df_pandas) -> list:
    cols = sorted(df_pandas.columns)
    out = []
    for rec in df_pandas[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name, build, sql, sf_dir, con):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    sp = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=True, rows=len(sp), note="no oracle", spark_s=round(t1 - t0, 2))
    dp = con.execute(sql).df()
    t2 = time.time()
    res = dict(name=name, rows=len(sp), oracle_rows=len(dp), spark_s=round(t1 - t0, 2),
               duck_s=round(t2 - t1, 2))
    if sorted(sp.columns) != sorted(dp.columns):
        res.update(ok=False, note=f"columns {sorted(sp.columns)} vs {sorted(dp.columns)}")
        return res
    a, b = rows_of(sp), rows_of(dp)
    if a == b:
        res.update(ok=True)
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res.update(ok=False, note=f"first diffs: {diff}" if diff else "row count differs")
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from comboscore.session import get_spark
    import __spark_entry__ as E
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or sorted(qs)):
        try:
            r = compare(spark, name, qs[name], sqls.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, note=f"{type(e).__name__}: {str(e)[:400]}")
        bad += not r["ok"]
        print(r, flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
