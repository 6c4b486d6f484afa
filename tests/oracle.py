"""Compare a Spark result with a DuckDB result: columns by name, rows as a multiset."""

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(item) for item in value)
    return value


def multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(v).__name__, v) for v in (canonical(row[i]) for i in order)) for row in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both agree, else a short account of the difference."""
    cursor = con.execute(sql)
    duck_columns = [item[0] for item in cursor.description]
    duck_rows = cursor.fetchall()
    spark_rows = spark_df.collect()
    if sorted(spark_df.columns) != sorted(duck_columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(duck_columns)}"
    ours, theirs = multiset(spark_df.columns, spark_rows), multiset(duck_columns, duck_rows)
    if ours == theirs:
        return None
    only_ours, only_theirs = list((ours - theirs).elements()), list((theirs - ours).elements())
    return f"rows {len(spark_rows)} / {len(duck_rows)}, only ours {only_ours[:2]}, only theirs {only_theirs[:2]}"
