"""Catalogs and sample values of the star-schema tables."""

from functools import reduce

from pyspark.sql import DataFrame, Row, Window, functions as F

from demo import views as V
from demo.registry import query
from sqlcurate.operators.catalog import (
    COLUMN_KEY, database_values, render_schemas, sampleable_columns, top_values,
)
from sqlcurate.sources import readers


def flat_catalog(spark, sf):
    """`order_catalog` with columns numbered inside their table."""
    lines = V.order_catalog(spark, sf)
    at = Window.partitionBy("db_id", "slot").orderBy("line")
    return lines.select(
        "db_id", F.col("slot").alias("table_idx"), "table_name",
        (F.row_number().over(at) - 1).alias("column_idx"), "column_name",
    )


def star_catalog(spark):
    rows = [
        Row(db_id="star", table_idx=t, table_name=table, column_idx=c, column_name=column)
        for t, (table, columns) in enumerate(V.STAR_CATALOG.items())
        for c, column in enumerate(columns)
    ]
    schema = "db_id string, table_idx int, table_name string, column_idx int, column_name string"
    return spark.createDataFrame(rows, schema)


def star_session(spark, sf):
    return readers.register_database(readers.new_database_session(spark), sf, list(V.STAR_CATALOG))


def star_values(spark, sf):
    """Cells of the sampleable columns, from the whole tables."""
    return database_values(star_catalog(spark), {"star": star_session(spark, sf)})


DUCK_STAR = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, {t} AS table_idx, {c} AS column_idx, '{column}' AS column_name, {column}::VARCHAR AS value FROM {table}"
    for t, (table, columns) in enumerate(V.STAR_CATALOG.items())
    for c, column in enumerate(columns[:4])
    if "_id" not in column
)
DUCK_TOP = f"""
    , cells AS ({DUCK_STAR}),
    d AS (SELECT DISTINCT * FROM cells WHERE value IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY table_idx, column_idx ORDER BY value) AS value_rank FROM d),
    top AS (SELECT *, dense_rank() OVER (PARTITION BY table_idx ORDER BY column_idx) AS column_rank FROM r WHERE value_rank <= 3),
    kept AS (SELECT *, left(value, 20) AS preview FROM top WHERE column_rank <= 2)"""


@query("f7_sampleable_columns", """
    , numbered AS (SELECT *, row_number() OVER (PARTITION BY db_id, slot ORDER BY line) - 1 AS pos,
                          CASE WHEN line = 2 THEN 'ID' WHEN line = 3 THEN 'Line_Id_3' ELSE column_name END AS name FROM cat)
    SELECT db_id, table_name, name AS column_name FROM numbered
    WHERE pos < 4 AND NOT contains(lower(name), '_id') AND lower(name) <> 'id'""")
def f7(spark, sf):
    named = flat_catalog(spark, sf).withColumn(
        "column_name",
        F.when(F.col("column_name") == "line_2", "ID").when(F.col("column_name") == "line_3", "Line_Id_3")
        .otherwise(F.col("column_name")),
    )
    return sampleable_columns(named).select("db_id", "table_name", "column_name")


@query("a13_sample_values", DUCK_TOP + "SELECT table_name, column_name, value_rank, preview FROM kept")
def a13(spark, sf):
    return top_values(star_values(spark, sf)).select("table_name", "column_name", "value_rank", "preview")


@query("w6_top_values", DUCK_TOP + "SELECT table_name, column_name, column_rank, value_rank, value FROM top WHERE column_rank <= 1")
def w6(spark, sf):
    top = top_values(star_values(spark, sf), per_column=3, per_table=1)
    return top.select("table_name", "column_name", "column_rank", "value_rank", "value")


# A database per nation, each with a customer and a supplier table.
NATION_TABLES = {
    "customer": ("c_nationkey", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]),
    "supplier": ("s_nationkey", ["s_suppkey", "s_name", "s_acctbal"]),
}


def nation_catalog(spark, sf):
    columns = F.array(*[
        F.struct(
            F.lit(t).alias("table_idx"), F.lit(table).alias("table_name"),
            F.lit(c).alias("column_idx"), F.lit(column).alias("column_name"),
        )
        for t, (table, (_, names)) in enumerate(NATION_TABLES.items()) for c, column in enumerate(names)
    ])
    nations = V.read(spark, sf, "nation")
    return nations.select(V.text("nation_", F.col("n_nationkey")).alias("db_id"), F.inline(columns))


def nation_values(spark, sf):
    parts = []
    for t, (table, (owner, names)) in enumerate(NATION_TABLES.items()):
        rows = V.read(spark, sf, table)
        cells = [(c, name) for c, name in enumerate(names) if name not in ("c_acctbal", "s_acctbal")]
        parts.append(rows.select(
            V.text("nation_", F.col(owner)).alias("db_id"), F.lit(t).alias("table_idx"), F.lit(table).alias("table_name"),
            F.inline(F.array(*[
                F.struct(F.lit(c).alias("column_idx"), F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))
                for c, name in cells
            ])),
        ))
    return reduce(DataFrame.unionByName, parts).select(*COLUMN_KEY, "value")


DUCK_NATION = """
    , cells AS (SELECT 'nation_' || c_nationkey AS db_id, 0 AS t, 0 AS c, 'c_custkey' AS name, c_custkey::VARCHAR AS value FROM customer
      UNION ALL SELECT 'nation_' || c_nationkey, 0, 1, 'c_name', c_name FROM customer
      UNION ALL SELECT 'nation_' || c_nationkey, 0, 2, 'c_mktsegment', c_mktsegment FROM customer
      UNION ALL SELECT 'nation_' || s_nationkey, 1, 0, 's_suppkey', s_suppkey::VARCHAR FROM supplier
      UNION ALL SELECT 'nation_' || s_nationkey, 1, 1, 's_name', s_name FROM supplier),
    d AS (SELECT DISTINCT * FROM cells),
    r AS (SELECT *, row_number() OVER (PARTITION BY db_id, t, c ORDER BY value) AS k FROM d),
    per_col AS (SELECT db_id, t, c, name || ': ' || string_agg(left(value, 20), ', ' ORDER BY k) AS line
                FROM r WHERE k <= 3 AND c < 2 GROUP BY db_id, t, c, name),
    per_table AS (SELECT db_id, t, string_agg(line, '; ' ORDER BY c) AS line FROM per_col GROUP BY db_id, t),
    ddl AS (SELECT 'nation_' || n_nationkey AS db_id, 0 AS t, 'CREATE TABLE customer (c_custkey, c_name, c_mktsegment, c_acctbal)' AS ddl FROM nation
            UNION ALL SELECT 'nation_' || n_nationkey, 1, 'CREATE TABLE supplier (s_suppkey, s_name, s_acctbal)' FROM nation),
    texts AS (SELECT db_id, string_agg(ddl || coalesce(chr(10) || '-- Sample values: ' || line, ''), chr(10) || chr(10) ORDER BY t) AS schema_text
              FROM ddl LEFT JOIN per_table USING (db_id, t) GROUP BY db_id)"""


@query("p16_render_schemas_with_samples", DUCK_NATION + "SELECT db_id, schema_text FROM texts")
def p16_samples(spark, sf):
    return render_schemas(nation_catalog(spark, sf), top_values(nation_values(spark, sf)))
