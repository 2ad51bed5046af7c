"""Run queries of __spark_entry__ beside their SQL in DuckDB: python tests/compare.py FOLDER [NAME...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def difference(spark, con, folder, query, sql):
    """None if query and SQL agree, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    out = con.execute(sql)
    want = rows_of([c[0] for c in out.description], out.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    odd = [x for x in zip(got[1], want[1]) if x[0] != x[1]][:2]
    return f"{len(got[1])} and {len(want[1])} rows; {odd}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con = entry.queries(), entry.oracle_sql(), database(sys.argv[1])
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            said = difference(spark, con, sys.argv[1], queries[name], sql[name]) if name in sql else f"(no SQL) {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:400]}"
        print(f"{name}: {said or 'same'} [{time.time() - t:.1f} s]", flush=True)
