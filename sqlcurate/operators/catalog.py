"""Database catalogs: sample values and rendered schema text.

`catalog(db_id, table_idx, table_name, column_idx, column_name)` has one row per column, and one
with a NULL column for a table without columns. `column_idx` counts from 0 inside its table.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sqlcurate.functions.cells import cell_preview, cell_text

COLUMN_KEY = ["db_id", "table_idx", "table_name", "column_idx", "column_name"]


def key_like(column_name: Column) -> Column:
    lowered = F.lower(column_name)
    return lowered.contains("_id") | (lowered == "id")


def sampleable_columns(catalog: DataFrame, first: int = 4) -> DataFrame:
    """Columns worth showing values of: among the first four of their table and not a key."""
    return catalog.filter((F.col("column_idx") < first) & ~key_like(F.col("column_name")))


def column_values(tables: dict[str, DataFrame], columns: list) -> DataFrame:
    """Non-null cells of catalog columns, melted to rows; each table is scanned once.

    `columns` are rows of the sampleable catalog of one database. Names are matched whatever their
    case; a table or column that is not there has no cells.
    """
    by_name, melted = {name.lower(): table for name, table in tables.items()}, []
    for name in dict.fromkeys(column.table_name for column in columns):
        table = by_name.get(name.lower())
        fields = {} if table is None else {field.name.lower(): field for field in table.schema}
        own = [column for column in columns if column.table_name == name and (column.column_name or "").lower() in fields]
        if not own:
            continue
        found = [fields[column.column_name.lower()] for column in own]
        cells = F.inline(F.array(*[
            F.struct(
                *[F.lit(getattr(column, key)).alias(key) for key in COLUMN_KEY],
                cell_text(F.col(f"`{field.name.replace('`', '``')}`"), field.dataType).alias("value"),
            )
            for column, field in zip(own, found)
        ]))
        melted.append(table.select(cells).filter(F.col("value").isNotNull()))
    if not melted:
        kind = "db_id string, table_idx int, table_name string, column_idx int, column_name string, value string"
        return SparkSession.active().createDataFrame([], kind)
    return reduce(DataFrame.unionByName, melted)


def united(parts: list[DataFrame]) -> DataFrame:
    """All parts in one plan, joined two by two, so that analysing it takes n log n steps and not n^2."""
    while len(parts) > 1:
        parts = [left.unionByName(right) for left, right in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def database_values(catalog: DataFrame, sessions: dict[str, SparkSession], first: int = 4) -> DataFrame:
    """Cells of the sampleable columns of all databases, from the whole tables, in one plan.

    `sessions` holds for each database a session with its tables as views. The catalog says which columns to read: one
    job lists them for all databases together, at most `first` for a table, and no further job runs before the cells
    are asked for. A database without a session has no cells.
    """
    listed = sampleable_columns(catalog, first).select(*COLUMN_KEY).collect()
    of_database: dict[str, list] = {}
    for column in sorted(listed, key=lambda column: (column.table_idx, column.column_idx)):
        of_database.setdefault(column.db_id, []).append(column)
    parts = []
    for db_id, session in sessions.items():
        columns = of_database.get(db_id, [])
        views = session._jsparkSession.sessionState().catalog()  # asking the public catalog takes jobs for each database
        asked = {column.table_name for column in columns if views.getTempView(column.table_name).isDefined()}
        parts.append(column_values({name: session.table("`" + name.replace("`", "``") + "`") for name in asked}, columns))
    return united(parts) if parts else column_values({}, [])


def top_values(values: DataFrame, per_column: int = 3, per_table: int = 2) -> DataFrame:
    """First distinct values of each column, for the first columns of a table that have any.

    Values are made distinct before they are ranked, and the rank limit is applied on both sides of
    the second shuffle, so a column contributes at most `per_column` rows per task to it.
    """
    by_value = Window.partitionBy(*COLUMN_KEY).orderBy("value")
    ranked = (
        values.select(*COLUMN_KEY, "value").distinct()
        .withColumn("value_rank", F.row_number().over(by_value))
        .filter(F.col("value_rank") <= per_column)
    )
    by_column = Window.partitionBy("db_id", "table_idx").orderBy("column_idx")
    return (
        ranked.withColumn("column_rank", F.dense_rank().over(by_column))
        .filter(F.col("column_rank") <= per_table)
        .withColumn("preview", cell_preview(F.col("value")))
    )


def _joined(df: DataFrame, keys: list[str], position: str, text: str, separator: str, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(position, text)))
    return df.groupBy(*keys).agg(F.concat_ws(separator, F.transform(parts, lambda part: part[text])).alias(name))


def render_schemas(catalog: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """`schemas(db_id, schema_text)`: one CREATE TABLE line per table, tables in catalog order.

    What is collected per group is the list of columns of one database, the very text that is
    rendered, not data of its tables.
    """
    tables = ["db_id", "table_idx", "table_name"]
    named = catalog.withColumn("column_name", F.coalesce("column_name", F.lit("")))
    ddl = _joined(named, tables, "column_idx", "column_name", ", ", "_columns").withColumn(
        "_ddl", F.concat(F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" ("), F.col("_columns"), F.lit(")"))
    )
    if samples is not None:
        shown = _joined(samples, [*tables, "column_idx", "column_name"], "value_rank", "preview", ", ", "_values")
        shown = shown.withColumn("_shown", F.concat("column_name", F.lit(": "), "_values"))
        lines = _joined(shown, tables, "column_idx", "_shown", "; ", "_line")
        ddl = ddl.join(lines, tables, "left").withColumn(
            "_ddl", F.concat("_ddl", F.coalesce(F.concat(F.lit("\n-- Sample values: "), "_line"), F.lit("")))
        )
    return _joined(ddl, ["db_id"], "table_idx", "_ddl", "\n\n", "schema_text")
