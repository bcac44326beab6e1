"""Run every registered query against its SQL equivalent: ``python tests/verify.py [sf_dir] [names]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SQL_SECONDS = 40
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value) + 0.0:.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str | None:
    """None if both sides agree, else a short description of the difference."""
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    alarm = threading.Timer(SQL_SECONDS, con.interrupt)
    alarm.start()
    try:
        cursor = con.execute(sql)
    finally:
        alarm.cancel()
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if ours == theirs:
        return None
    extra = sorted(set(ours) - set(theirs))[:2]
    lacking = sorted(set(theirs) - set(ours))[:2]
    return f"{len(ours)} / {len(theirs)} rows; only Spark {extra}; only SQL {lacking}"


def main() -> int:
    import __spark_entry__ as entry

    from visitorlens.plans.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, sf_dir, name, queries[name], oracle[name])
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:
            problem = str(error)[:600]
        failed += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{kind} {name:26s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{failed} failed; without SQL: {sorted(set(queries) - set(oracle))}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
