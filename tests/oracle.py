"""Compare a registered query with its SQL counterpart run by DuckDB on the same files.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("cohortloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_sql(sf_dir: str, sql: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = [str(d[1]).upper() for d in result.description]
    return names, types, result.fetchall()


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(row[i] for i in order) for row in rows]
    return sorted(table, key=lambda row: tuple((v is None, str(v)) for v in row))


def _canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def differences(df, sf_dir: str, sql: str) -> list[str]:
    """What differs, in words; empty when names, types, row count and values agree."""
    rows = [tuple(r) for r in df.collect()]
    names, types, expected = run_sql(sf_dir, sql)
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    sql_types = dict(zip(names, types))
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind).upper() not in sql_types[name]:
            problems.append(f"type of {name}: {kind} / {sql_types[name]}")
    if len(rows) != len(expected):
        problems.append(f"rows {len(rows)} / {len(expected)}")
    ours, theirs = _sorted_rows(df.columns, rows), _sorted_rows(names, expected)
    wrong = [(a, b) for a, b in zip(ours, theirs) if tuple(map(_canonical, a)) != tuple(map(_canonical, b))]
    if wrong:
        problems.append(f"{len(wrong)} rows differ in {sorted(names)}, such as {wrong[0][0]} / {wrong[0][1]}")
    return problems


def main() -> int:
    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = contract.queries(), contract.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    spark = local_session()
    failed = 0
    for name in chosen:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problems = differences(df, sf_dir, oracles[name])
                state = "ok" if not problems else "DIFFERS " + "; ".join(problems)
            else:
                problems = []
                state = f"rows only: {df.count()} {df.dtypes}"
        except Exception as error:  # report and go on with the next query
            problems = [error]
            state = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problems)
        print(f"{time.time() - started:6.1f}s {name}: {state}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
