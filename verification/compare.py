"""Run queries and their SQL side by side and compare all rows.

    python -m verification.compare /root/testdata/sf0.01 [query ...]
"""

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

from verification import oracle
from verification.queries import QUERIES, run

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else int(value) if value.is_integer() else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows), sorted(columns)


# DuckDB names of the Spark types that results have.
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE"}


def _types(df, result):
    got = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    want = {d[0]: str(d[1]) for d in result.description}
    return {c: (got[c], want[c]) for c in got if got[c] != want[c]}


def compare(name, spark, con, sf_dir):
    """None if the results are equal, else what differs."""
    df = run(name, spark, sf_dir)
    got, columns = _rows(df.columns, df.collect())
    if name not in oracle.SELECTS:
        return None
    result = con.execute(oracle.sql(name))
    want, expected = _rows([d[0] for d in result.description], result.fetchall())
    if columns != expected:
        return f"columns {columns} instead of {expected}"
    if _types(df, result):
        return f"types {_types(df, result)}"
    if got != want:
        extra, lack = got - want, want - got
        return f"{sum(extra.values())} rows too many, {sum(lack.values())} missing of {sum(want.values())}: {list(extra)[:2]} {list(lack)[:2]}"
    if not got:
        return "no rows"
    return None


def main():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(name, spark, con, sf_dir)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
