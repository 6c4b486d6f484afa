"""Where intermediate tables go."""

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go when the query ends; else they stay until the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder named by `spark.checkpoint.dir`.

    Without that setting a temporary folder serves a local session; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sqlcurate-")
    return f"{root.rstrip('/')}/sqlcurate/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application has stored. What was read from them is gone after that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/sqlcurate/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a written table: computed once, with no lineage behind it."""
    return stored_parts([df], name)


def stored_parts(parts: Iterable[DataFrame], name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """The rows of one or more tables with the same columns, each asked for and written when the one before is.

    The settings hold while a table is written.
    """
    settings = {CLEANED: "true", **(settings or {})}
    paths = []
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        paths.append(scratch_path(spark, name))
        before = {key: spark.conf.get(key) for key in settings}
        for key, value in settings.items():
            spark.conf.set(key, value)
        try:
            df.write.parquet(paths[-1])
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
    return spark.read.schema(schema).parquet(*paths)
