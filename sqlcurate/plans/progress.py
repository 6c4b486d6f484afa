"""Progress over iterations."""

from pyspark.sql import DataFrame, functions as F

from sqlcurate import schemas as S
from sqlcurate.operators.reports import best_iteration, improvement, running_best


def progress_report(history: DataFrame) -> DataFrame:
    """History with the gain over the previous iteration, new bests, and the best iteration marked."""
    best = best_iteration(history).select("iteration", F.lit(True).alias("is_best"))
    report = running_best(improvement(history)).join(best, "iteration", "left")
    return report.withColumn("is_best", F.coalesce("is_best", F.lit(False)))


def iteration_record(iteration: int, mix: DataFrame, dev: DataFrame) -> DataFrame:
    """History row of an iteration from its `mix_summary` and the `run_summary` of its dev evaluation."""
    both = mix.unionByName(dev.select(F.col("accuracy").alias("dev_accuracy")), allowMissingColumns=True)
    counters = [name for name in mix.columns if name in S.HISTORY.fieldNames()]
    return both.agg(*[F.max(name).alias(name) for name in [*counters, "dev_accuracy"]]).select(
        F.lit(iteration).alias("iteration"), "*", F.current_timestamp().alias("ts")
    )
