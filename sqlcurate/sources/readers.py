"""Readers for questions, catalogs, gold statements, errors files, reports and history.

The files this library replaces are single JSON documents. Each reader takes those, and by default
JSON Lines, the layout that Spark can split.
"""

from pyspark.sql import DataFrame, SparkSession, Window, types as T, functions as F

from sqlcurate import schemas as S
from sqlcurate.functions.scoring import gold_of
from sqlcurate.sources.documents import document_entries
from sqlcurate.sources.storage import stored

# File of each split.
SPLIT_FILES = {"train": "train_spider.json", "dev": "dev.json"}
CATALOG_FILE = "tables.json"


def content_id(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `question_id`: a hash of the content and of its occurrence, so equal entries stay apart. A given id stays.

    Entries are numbered in two steps, as one content may be that of most rows: inside the part of the input they were
    read with, from the number of equal entries in the parts before. The entries are stored with the number of their
    part first, since files need not be cut alike when they are read again; so files are read and parsed once.
    """
    others = [name for name in parts.columns if name != "question_id"]
    content = F.concat_ws("\x01", *[F.coalesce(name, F.lit("")) for name in columns])
    placed = stored(parts.select("*", F.sha2(content, 256).alias("_key"), F.spark_partition_id().alias("_part")), "entries")
    fresh = placed.filter("question_id IS NULL").drop("question_id") if "question_id" in parts.columns else placed
    made = numbered(fresh, ["_key"], "_part").select(
        F.sha2(F.concat_ws("\x01", content, F.col("_nth").cast("string")), 256).alias("question_id"), *others
    )
    if "question_id" not in parts.columns:
        return made
    return placed.filter("question_id IS NOT NULL").select("question_id", *others).unionByName(made)


def numbered(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Adds `_nth`: 1, 2, 3, ... over the rows of equal `keys`, in the order of `part`.

    A window holds the rows of one key and part, and the one over parts a row for each part.
    """
    counts = rows.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    # Most keys stand in one part only and need no join partner.
    offsets = counts.withColumn("_before", before).filter(F.col("_before") > 0).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.lit(0)))
    return rows.withColumn("_own", own).join(offsets, [*keys, part], "left").withColumn(
        "_nth", F.col("_own") + F.coalesce("_before", F.lit(0))
    ).drop("_own", "_before")


def load_questions(spark: SparkSession, folder: str, document: bool = False, id_column: str | None = None) -> DataFrame:
    """`questions(question_id, split, db_id, question, gold_sql)` of all splits.

    The id is the entry's own field `id_column`, if one is named. Otherwise it is a hash of the content
    and its occurrence number, so it is stable and unique, also where entries are equal. `document`
    reads one JSON array per file.
    """
    kind = T.StructType([*S.RAW_QUESTIONS.fields, *([T.StructField(id_column, T.StringType())] if id_column else [])])
    own = [F.col(f"`{id_column}`").alias("question_id")] if id_column else []
    parts = None
    for split, name in SPLIT_FILES.items():
        part = spark.read.json(f"{folder}/{name}", schema=kind, multiLine=document).select(
            *own, F.lit(split).alias("split"), "db_id", "question", F.col("query").alias("gold_sql")
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts if id_column else content_id(parts, ["split", "db_id", "question", "gold_sql"])


def load_catalog(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Flat catalog. Column entries of no table, such as the `*` entry, drop out; empty tables stay."""
    raw = spark.read.json(path, schema=S.RAW_CATALOG, multiLine=document)
    tables = raw.select(
        "db_id", "column_names_original", F.posexplode("table_names_original").alias("table_idx", "table_name")
    )
    own = F.filter("column_names_original", lambda entry: entry[0].cast("int") == F.col("table_idx"))
    return tables.select(
        "db_id", "table_idx", "table_name",
        F.posexplode_outer(F.transform(own, lambda entry: entry[1])).alias("column_idx", "column_name"),
    )


def load_gold_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", escape="", schema=S.GOLD_TSV)


def register_database(spark: SparkSession, folder: str, tables: list[str]) -> SparkSession:
    """Expose the tables of one database, stored as `<folder>/<table>.parquet`, as views.

    The views live in the session given. Use `new_database_session` where several databases with
    equal table names are open at once.
    """
    for table in tables:
        spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(table)
    return spark


def new_database_session(spark: SparkSession) -> SparkSession:
    """A session with its own views and the settings of the given one."""
    child = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            child.conf.set(name, value)
    return child


def load_errors(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Entries of errors files with ids and gold, with `error_category` where the file groups them.

    Layouts: `lines`, one entry per line, as written by `write_errors`; `document`, one JSON
    document per file, either a list of entries or an object with `errors` as a map from category
    to entries; `documents`, one such document per line. A `document` is cut into entries by many tasks. An entry
    without an id gets one from its content, and `gold_sql` is taken from `query` in older files.
    """
    columns = [*S.ERROR_ENTRY.fieldNames(), "error_category"]
    if layout == "lines":
        entries = spark.read.json(path, schema=S.ERROR_ENTRY).withColumn("error_category", F.lit(None).cast("string"))
    elif layout == "document":
        parsed = document_entries(spark, path).select(F.col("category").alias("error_category"), F.from_json("entry", S.ERROR_ENTRY).alias("entry"))
        entries = parsed.select("entry.*", "error_category")
    else:
        texts = spark.read.text(path)
        kind = T.ArrayType(S.ERROR_ENTRY)
        wrapped = T.StructType([T.StructField("errors", T.MapType(T.StringType(), kind))])
        listed = F.ltrim(F.col("value")).startswith("[")
        flat = texts.filter(listed).select(F.lit(None).cast("string").alias("error_category"), F.inline(F.from_json("value", kind)))
        grouped = (
            texts.filter(~listed)
            .select(F.explode(F.from_json("value", wrapped)["errors"]).alias("error_category", "_entries"))
            .select("error_category", F.inline("_entries"))
        )
        entries = flat.select(columns).unionByName(grouped.select(columns))
    named = entries.withColumn("gold_sql", gold_of(entries))
    return content_id(named, ["db_id", "question", "gold_sql"]).select(columns)


def load_reports(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Run reports; a field that a report lacks is NULL."""
    return spark.read.json(path, schema=S.REPORTS, multiLine=document)


def load_history(spark: SparkSession, path: str, schema: T.StructType = S.HISTORY) -> DataFrame:
    """A history table as `append_history` writes it."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
