"""Run registered queries and their SQL checks side by side: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, build, sql, folder) -> list[str]:
    df = build(spark, folder)
    mine_c, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    other_c, other = rows_of([d[0] for d in found.description], found.fetchall())
    out = []
    if mine_c != other_c:
        out.append(f"columns {mine_c} / {other_c}")
    if len(mine) != len(other):
        out.append(f"rows {len(mine)} / {len(other)}")
    wrong = [(a, b) for a, b in zip(mine, other) if a != b]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return out


def local_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in checks:
                wrong = differences(spark, con, build, checks[name], folder)
            else:
                wrong = []
                count = build(spark, folder).count()
                name = f"{name} (rows only: {count})"
        except Exception as error:
            wrong = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok  '} {time.time() - start:6.2f}s {name} {' | '.join(wrong)[:900]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
