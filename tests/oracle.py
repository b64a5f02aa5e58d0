"""Runs queries in Spark and in DuckDB and compares their rows."""

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def norm(x):
    return float(f"{x:.9g}") if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    return [columns[j] for j in order], Counter(tuple(norm(r[j]) for j in order) for r in rows)


def compare(df, con, sql):
    """None if both give the same rows, else what differs."""
    rel = con.execute(sql)
    names, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    own, got = rows_of(df.columns, df.collect())
    if names != own:
        return f"columns {own} and {names}"
    if want != got:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:3]}; only DuckDB: {list((want - got).items())[:3]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name, f in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if name in oracles:
                found = compare(f(spark, sf_dir), con, oracles[name])
            else:
                found = f"rows only: {f(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        print(name, "same" if found is None else found, f"{time.time() - began:.1f} s", flush=True)
