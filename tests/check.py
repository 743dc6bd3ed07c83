"""Compare registered queries with their SQL on one scale: ``python tests/check.py sf0.01 [key…]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from cohortlens.session import local_session  # noqa: E402
from cohortlens.sources.derived import RAW_TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in RAW_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = sorted(repr(tuple(row[i] for i in order)) for row in rows)
    return [columns[i] for i in order], text


def difference(spark, con, sf_dir: str, key: str) -> str | None:
    """What differs between the two answers, or None."""
    df = entry.queries()[key](spark, sf_dir)
    got = _ordered(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(entry.oracle_sql()[key])
    want = _ordered([d[0] for d in answer.description], answer.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} / {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"\n  spark {a}\n  sql   {b}"
    return None if got[1] else "no rows"


def main() -> None:
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for key in sys.argv[2:] or entry.oracle_sql():
        started = time.time()
        found = difference(spark, con, sf_dir, key)
        print(f"{key:28} {'ok' if found is None else found[:1500]} {time.time() - started:.1f}s", flush=True)
        failed += [key] if found else []
    print("failed:", failed)


if __name__ == "__main__":
    main()
