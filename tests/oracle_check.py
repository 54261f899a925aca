"""Run registered queries next to their SQL and compare the rows.

``python tests/oracle_check.py /root/testdata/sf0.01 [query ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(value):
    return "none" if value is None else type(value).__name__


def compare(df, con, sql: str) -> str:
    """'' if both have the same columns, value types and rows, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    expected = [tuple(row[names.index(c)] for c in order) for row in result.fetchall()]
    actual = [tuple(row[c] for c in order) for row in df.collect()]
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"

    def key(row):
        return tuple((v is not None, str(v)) for v in row)

    actual.sort(key=key)
    expected.sort(key=key)
    for a, e in zip(actual, expected):
        if a != e or [_kind(v) for v in a] != [_kind(v) for v in e]:
            return f"{dict(zip(order, a))} != {dict(zip(order, e))}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from tasador.session import local_session

    sf_dir, *names = sys.argv[1:]
    spark = local_session(8)
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if (names and name not in names) or name not in oracles:
            continue
        start = time.time()
        try:
            problem = compare(run(spark, sf_dir), con, oracles[name])
        except Exception as error:  # report and go on with the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{name:22s} {time.time() - start:6.1f}s {'ok' if not problem else problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
