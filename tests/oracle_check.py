"""Compare registered queries with their SQL on the given tables.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def cell(x):
        if x is None or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)

    out = df[sorted(df.columns)].map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty string if equal, else a description of the first difference."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} / {len(sql_df)}"
    kinds = [(c, str(spark_df[c].dtype), str(sql_df[c].dtype)) for c in sorted(spark_df.columns)]
    odd = [k for k in kinds if k[1] != k[2] and len(spark_df)]
    a, b = normal(spark_df), normal(sql_df)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        return f"{bad.sum()} of {len(a)} rows differ: {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return f"types {odd}" if odd else ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("glossaria")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(a in n for a in args)]
    spark, con, failed = session(), connect(sf_dir), []
    for name in names:
        t0 = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"rows-only {name} {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            message = compare(got, want)
        except Exception as error:
            t1, message = time.time(), f"{type(error).__name__}: {str(error)[:700]}"
        if message:
            failed.append(name)
        status = f"FAIL {message}" if message else f"ok {len(got)} rows"
        print(f"{name}: {status} spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
