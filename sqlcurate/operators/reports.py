"""Run summaries, position tables and iteration history.

Windows without a partition appear only over tables with one row per iteration or per candidate
position.
"""

from pyspark.sql import DataFrame, Window, functions as F

from sqlcurate.functions.scoring import ratio


def run_summary(verdicts: DataFrame, **config) -> DataFrame:
    """Totals of one evaluation run; `config` values (model, split, strategy, ...) become columns."""
    return verdicts.agg(
        F.count("*").alias("total"), F.count_if("is_correct").alias("correct")
    ).select(
        *[F.lit(value).alias(name) for name, value in config.items()],
        "total", "correct", ratio(F.col("correct"), F.col("total")).alias("accuracy"),
    )


def dataset_stats(questions: DataFrame) -> DataFrame:
    """Questions and databases per split, and in total."""
    return (
        questions.rollup("split").agg(
            F.grouping("split").alias("_all"), F.count("*").alias("n_rows"), F.countDistinct("db_id").alias("n_dbs")
        )
        .select(F.when(F.col("_all") == 1, "total").otherwise(F.col("split")).alias("split"), "n_rows", "n_dbs")
    )


def correct_by_position(verdicts: DataFrame) -> DataFrame:
    return (
        verdicts.filter("is_correct")
        .groupBy(F.coalesce("candidate_idx", F.lit(1)).alias("candidate_idx"))
        .agg(F.count("*").alias("n_correct"))
    )


def cumulative_by_position(verdicts: DataFrame) -> DataFrame:
    """Correct questions up to each candidate position and their share of all questions."""
    position = F.when(F.col("is_correct"), F.coalesce("candidate_idx", F.lit(1)))
    counted = verdicts.groupBy(position.alias("candidate_idx")).agg(F.count("*").alias("n_correct"))
    so_far = Window.orderBy("candidate_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counted.withColumn("_total", F.sum("n_correct").over(Window.partitionBy()))
        .filter("candidate_idx IS NOT NULL")
        .withColumn("cumulative", F.sum("n_correct").over(so_far))
        .select("candidate_idx", "n_correct", "cumulative", ratio(F.col("cumulative"), F.col("_total")).alias("share"))
    )


def improvement(history: DataFrame) -> DataFrame:
    previous = F.lag("train_accuracy", 1, 0.0).over(Window.orderBy("iteration"))
    return history.withColumn("improvement", F.col("train_accuracy") - previous)


def running_best(history: DataFrame) -> DataFrame:
    """Best dev accuracy before each iteration, and whether the iteration beats it."""
    earlier = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max("dev_accuracy").over(earlier), F.lit(0.0)), F.lit(0.0))
    return history.withColumn("best_before", best).withColumn(
        "is_new_best", F.coalesce(F.col("dev_accuracy"), F.lit(0.0)) > F.col("best_before")
    )


def best_iteration(history: DataFrame) -> DataFrame:
    """Iteration with the highest dev accuracy; the earliest one among equals."""
    best = F.max(F.struct(
        F.coalesce("dev_accuracy", F.lit(0.0)).alias("dev_accuracy"), (-F.col("iteration")).alias("_order")
    )).alias("best")
    return history.agg(best).filter("best IS NOT NULL").select(
        (-F.col("best._order")).alias("iteration"), F.col("best.dev_accuracy").alias("dev_accuracy")
    )


def last_state(history: DataFrame) -> DataFrame:
    """Latest saved row, the point to resume from."""
    rest = [name for name in history.columns if name != "iteration"]
    return history.agg(F.max(F.struct("iteration", *rest)).alias("last")).filter("last IS NOT NULL").select("last.*")
