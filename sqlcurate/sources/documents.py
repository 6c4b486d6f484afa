"""Entries of large JSON documents, each document read by many tasks.

A document is cut at every closing brace, by Spark's splittable reader of text. Whether a piece begins inside a string,
and how deep, follows from the quotes and brackets of all pieces before it: these are summed inside each block of the
file and over blocks, so no task sees more than a block of pieces. Pieces between the ends of two entries are then put
together.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sqlcurate.sources.storage import stored

BLOCK = ["file", "block"]
# A JSON string without its quotes, and text from its beginning on, string by string.
INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
UP_TO = rf'(?s)^(?:[^"]++|"{INSIDE}")*?'
OBJECT_KEY, LIST_KEY = rf'{UP_TO}"({INSIDE})"\s*:\s*\{{', rf'{UP_TO}"({INSIDE})"\s*:\s*\[\s*(?=\{{)'


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth, value: the text up to each closing brace, and behind the last; stored as it was cut."""
    raw = spark.read.option("lineSep", "}").text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return stored(raw.select(*at, F.monotonically_increasing_id().alias("nth"), "value"), "pieces")


def with_sums(rows: DataFrame, **amounts: Column) -> DataFrame:
    """Adds, for each amount, its sum over all pieces of the file that come before."""
    rows = rows.withColumns({f"_{name}": amount for name, amount in amounts.items()})
    inside = Window.partitionBy(*BLOCK).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*BLOCK).agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in amounts])
    offsets = blocks.select(*BLOCK, *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}_of") for name in amounts])
    return rows.withColumns({name: F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) for name in amounts}).join(offsets, BLOCK).withColumns(
        {name: F.col(name) + F.col(f"_{name}_of") for name in amounts}
    ).drop(*[f"_{name}_of" for name in amounts])


def with_last(rows: DataFrame, **values: Column) -> DataFrame:
    """Adds, for each value, that of the piece or else of the last piece before it in the file that has one."""
    rows = rows.withColumns({f"_{name}": value for name, value in values.items()})
    inside = Window.partitionBy(*BLOCK).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = {name: F.when(F.col(f"_{name}").isNotNull(), F.col("nth")) for name in values}
    blocks = rows.groupBy(*BLOCK).agg(*[F.max_by(f"_{name}", known[name]).alias(f"_{name}") for name in values])
    offsets = blocks.select(*BLOCK, *[F.last(f"_{name}", ignorenulls=True).over(earlier).alias(f"_{name}_of") for name in values])
    return rows.withColumns({name: F.last(f"_{name}", ignorenulls=True).over(inside) for name in values}).join(offsets, BLOCK).withColumns(
        {name: F.coalesce(name, f"_{name}_of") for name in values}
    ).drop(*[f"_{name}{end}" for name in values for end in ("", "_of")])


def counted(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def document_entries(spark: SparkSession, path: str, under: str = "errors") -> DataFrame:
    """`(category, entry)`: the objects of each document's list, or of the lists below `under`, as JSON text.

    A document is a list of objects, which have no category, or an object whose field `under` maps categories to such
    lists; its other fields are passed over. A file may be empty. The text must be valid JSON.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # an escaped quote ends no string
    quoted = with_sums(pieces_of(spark, path), quotes=counted(bare, '"'))
    within = F.col("quotes") % 2 == 1
    closed = (F.col("quotes") + F.col("_quotes")) % 2 == 0  # the brace at the end is one of the structure
    outside = F.regexp_replace(F.concat(F.when(within, '"').otherwise(""), bare), r'"[^"]*+("|$)', "")
    deep = with_sums(
        quoted.withColumns({"closed": closed, "outside": outside}).drop("quotes", "_quotes"),
        depth=counted(F.col("outside"), "{[") - counted(F.col("outside"), "]") - F.col("closed").cast("int"),
    )
    kinds = (
        deep.filter(F.trim(F.translate("outside", "\r\n\t", "")) != "").groupBy("file")
        .agg(F.min_by(F.substring(F.ltrim(F.translate("outside", "\r\n\t", "")), 1, 1), F.struct("block", "nth")).alias("kind"))
    )
    placed = deep.join(kinds, "file").withColumn("level", F.when(F.col("kind") == "[", 1).otherwise(3))
    after = F.col("depth") + F.col("_depth")
    ended = placed.withColumns({"ends": F.col("closed") & (after <= F.col("level")), "whole": F.col("closed") & (after == F.col("level"))})
    # From the end of one object to that of the next, as long as neither lies inside an entry.
    first = F.struct("block", "nth")
    joined = with_sums(ended, record=F.col("ends").cast("int")).groupBy("file", "record").agg(
        F.max("whole").alias("whole"), F.first("kind").alias("kind"), F.first("level").alias("level"),
        F.min("block").alias("block"), F.min_by("nth", first).alias("nth"), F.min_by("depth", first).alias("depth"),
        F.array_sort(F.collect_list(F.struct("block", "nth", "value"))).alias("parts"),
    ).withColumn("text", F.concat(F.array_join(F.transform("parts", lambda part: part["value"]), "}"), F.lit("}"))).drop("parts")
    outer = F.col("depth") - counted(F.regexp_extract("text", r"^[\s\]]*", 0), "]")  # depth once lists have ended
    opens = (F.col("level") == 3) & (outer < 3)

    def named(pattern: str) -> Column:
        key = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
        return F.from_json(F.concat(F.lit('["'), key, F.lit('"]')), "array<string>")[0]

    known = with_last(joined.withColumn("opens", opens), top=F.when(opens & (outer <= 1), named(OBJECT_KEY)), category=F.when(opens, named(LIST_KEY)))
    entry = F.when(F.col("opens"), F.regexp_replace("text", LIST_KEY, "")).otherwise(F.regexp_replace("text", r"^[^{]*", ""))
    listed = F.col("kind") == "["
    return known.filter(F.col("whole") & (listed | (F.col("top") == under))).select(F.when(~listed, F.col("category")).alias("category"), entry.alias("entry"))
