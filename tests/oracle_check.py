"""Runs registered queries against their SQL: python tests/oracle_check.py [folder] [name …]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    """Rows with columns in name order, in an order of their own, as exact text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, db, name: str, folder: str, query, oracle: str | None) -> str:
    df = query(spark, folder)
    have = rows_of(df.columns, df.collect())
    if oracle is None:
        return f"rows {len(have)}"
    result = db.execute(oracle)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} <> {sorted(names)}"
    if have != want:
        extra, lacking = list(set(have) - set(want))[:2], list(set(want) - set(have))[:2]
        return f"FAIL {len(have)} rows <> {len(want)}; only here {extra}; only there {lacking}"
    return f"ok {len(have)}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from thermoline.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db, oracles, failed = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if sys.argv[2:] and not any(name.startswith(w) for w in sys.argv[2:]):
            continue
        start = time.time()
        try:
            verdict = compare(spark, db, name, folder, query, oracles.get(name))
        except Exception as error:  # report and go on
            verdict = "FAIL " + str(error).strip()[:600]
        failed += verdict.startswith("FAIL")
        print(f"{name:36s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
