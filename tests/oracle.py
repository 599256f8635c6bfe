"""Runs registered queries beside their SQL in DuckDB and compares rows: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda v: "null" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, else what differs."""
    got, want = fn(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; {only}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connect(sys.argv[1]), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in qs if not n.startswith("op") and n != "pipeline"]:
        at = time.time()
        try:
            said = compare(spark, con, name, qs[name], sqls[name], sys.argv[1]) if name in sqls else f"rows only: {qs[name](spark, sys.argv[1]).count()}"
        except Exception as e:  # noqa: BLE001
            said = "FAILED " + str(e)[:600]
        print(f"{name}: {said or 'same'} ({time.time() - at:.1f} s)", flush=True)
