"""Compare every query with its SQL: python tests/compare.py [folder] [query ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _sorted_rows(rows, order):
    picked = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((v is None, type(v).__name__, v) for v in r))


def spark_rows(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return sorted(df.columns), _sorted_rows([tuple(r) for r in df.collect()], order)


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), _sorted_rows(result.fetchall(), order)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, con, sql):
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {
        name: (kind, theirs.get(name))
        for name, kind in df.dtypes
        if KINDS.get(kind, kind) != theirs.get(name)
    }


def difference(spark, folder, con, query, sql):
    """None if equal, else a text that says how they differ; and the row count."""
    df = query(spark, folder)
    kinds = type_differences(df, con, sql)
    names, ours = spark_rows(df)
    their_names, theirs = sql_rows(con, sql)
    if names != their_names:
        return f"columns {names} / {their_names}", len(ours)
    if kinds:
        return f"types {kinds}", len(ours)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows / {len(theirs)} rows", len(ours)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, such as\n  {wrong[0][0]}\n  {wrong[0][1]}", len(ours)
    return None, len(ours)


def main():
    from fleetlens.session import session
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = session(master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = oracle(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if name not in sqls or (chosen and name not in chosen):
            continue
        begin = time.time()
        try:
            found, n = difference(spark, folder, con, query, sqls[name])
        except Exception as error:  # report and go on with the next query
            found, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name:28s} {n:8d} rows {time.time() - begin:6.2f}s {found or ''}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
