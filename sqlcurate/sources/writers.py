"""Writers. All outputs are folders of part files."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from sqlcurate import schemas as S
from sqlcurate.operators.questions import wrong_only


def write_sft(sft: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON Lines, compressed, as most of the text is copies and prompts that begin alike."""
    sft.select("instruction", "input", "output").write.json(path, compression=compression)


def write_report(runs: DataFrame, verdicts: DataFrame, path: str) -> None:
    """Totals, with the time of writing, and verdicts of a run as two tables, not one nested document."""
    runs.withColumn("timestamp", F.current_timestamp()).write.json(f"{path}/runs")
    verdicts.write.parquet(f"{path}/verdicts")


def write_errors(verdicts: DataFrame, path: str) -> None:
    wrong_only(verdicts).write.json(path)


def append_history(rows: DataFrame, path: str, schema: StructType = S.HISTORY) -> None:
    """Add iterations to a history table; an iteration that is there already is replaced.

    A partition per iteration: its rows are staged and take the place of the partition when the job commits, so a retry,
    or a second append of the same iteration, leaves one copy. Other iterations are not touched.
    """
    fields = [F.col(field.name).cast(field.dataType).alias(field.name) for field in schema.fields]
    whole = rows.select(*fields).repartition("iteration")  # one file per iteration
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration").parquet(path)
