"""Run registered queries against their SQL in DuckDB.

As a script: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(sql)
    return _counted([d[0] for d in result.description], result.fetchall())


def _counted(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def spark_rows(df) -> tuple[list[str], Counter]:
    return _counted(df.columns, [tuple(r) for r in df.collect()])


def differences(spark, folder: str, name: str) -> list[str]:
    """What differs between a query and its oracle; empty when equal."""
    got_names, got = spark_rows(contract.queries()[name](spark, folder))
    names, want = oracle_rows(folder, contract.oracle_sql()[name])
    if got_names != names:
        return [f"columns {got_names} != {names}"]
    out = [f"only Spark: {r}" for r in (got - want)][:3]
    out += [f"only oracle: {r}" for r in (want - got)][:3]
    return out if out or got else ["both empty"]


if __name__ == "__main__":
    from conftest import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(contract.queries())
    spark = session()
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in contract.oracle_sql():
                found = differences(spark, folder, name)
            else:
                rows = contract.queries()[name](spark, folder).collect()
                found = [] if rows else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.2f}s", flush=True)
        for line in found:
            print("    ", line)
    print(f"{len(chosen) - bad} of {len(chosen)} match")
