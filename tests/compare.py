"""Run registered queries next to their SQL and compare values."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return (0, "")
        if isinstance(x, (bool, int, float)) or hasattr(x, "item"):
            return (1, repr(float(x)))
        return (2, str(x))

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False, name=None))


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    a, b = normal(spark_df), normal(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from tastegrid import build_session

    folder = f"/root/testdata/{sys.argv[1]}"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(folder), oracle_sql()
    for name, fn in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder)
            types = dict(got.dtypes)
            got = got.toPandas()
        except Exception as e:
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"rows {name}: {len(got)} spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(sqls[name]).df()
        except Exception as e:
            print(f"SQLFAIL {name}: {str(e)[:600]}", flush=True)
            continue
        diff = differences(got, want)
        t2 = time.time()
        kinds = {c: (types[c], str(want[c].dtype)) for c in got.columns if c in want}
        odd = {c: k for c, k in kinds.items() if (k[0], k[1]) not in {("bigint", "int64"), ("double", "float64"), ("string", "object"), ("string", "str"), ("bigint", "Int64"), ("bigint", "float64")}}
        print(f"{'ok  ' if diff is None else 'DIFF'} {name}: {len(got)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s {diff or ''} {odd or ''}", flush=True)
