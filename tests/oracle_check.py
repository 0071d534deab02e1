"""Run registered queries next to their DuckDB statements and report differences.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("", "null")
    if isinstance(value, bool):
        return ("b", value)
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, float):
        return ("f", round(value, 6) + 0.0)
    return (type(value).__name__, str(value))


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        tuple(plain(r[i]) for i in order) for r in data
    )


def compare(spark_df, statement: str, con):
    left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(statement)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = left[1], right[1]
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"rows {len(a)} / {len(b)}; columns {left[0]}\n   spark: {only_a}\n   duckdb: {only_b}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if a != sf]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, statements = entry.queries(), entry.oracle_sql()
    con, bad = duck(sf), 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in statements:
                problem, kind = compare(df, statements[name], con), "ok"
            else:
                problem, kind = None, f"no oracle, {len(df.collect())} rows"
        except Exception as exc:
            problem, kind = f"{type(exc).__name__}: {str(exc)[:900]}", ""
        bad += problem is not None
        print(f"{name:28} {time.time() - t:6.1f}s  {kind if problem is None else 'DIFF ' + problem}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
