"""Run registered queries beside their SQL: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return repr(float(value) + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, run, sql, sf_dir):
    df = run(spark, sf_dir)
    mine = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(mine)
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a == b:
        types = {d[0]: str(d[1]) for d in cursor.description}
        odd = [n for n, t in df.dtypes if types[n] in ("HUGEINT", "DECIMAL")]
        return (f"wide types in {odd}" if odd else ""), len(mine)
    gone = sorted(set(a) - set(b))[:2]
    new = sorted(set(b) - set(a))[:2]
    return f"{len(a)} vs {len(b)} rows, {sorted(df.columns)}\n   spark {gone}\n   sql   {new}", len(mine)


def main():
    from __spark_entry__ import oracle_sql, queries
    from quillprint.session import build_session

    QUERIES, ORACLE = queries(), oracle_sql()
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", master="local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLE:
                problem, n = differences(spark, con, QUERIES[name], ORACLE[name], sf_dir)
            else:
                problem, n = "", len(QUERIES[name](spark, sf_dir).collect())
        except Exception as error:
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += bool(problem)
        kind = "sql " if name in ORACLE else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:26s} {n:7d} {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
