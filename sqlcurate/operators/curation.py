"""Training rows: copies of correct candidates, gold answers for unsolved questions, summaries."""

from pyspark.sql import Column, DataFrame, functions as F

from sqlcurate.functions.prompting import format_prompt, sft_prompt_as_input, sft_prompt_as_instruction
from sqlcurate.functions.scoring import ratio
from sqlcurate.operators.questions import question_stats

MIN_TRAINING_ROWS = 100
COPIES_PER_TASK_ROW = 10_000


def replicate(df: DataFrame, copies: Column) -> DataFrame:
    """`copies` rows for each row. For small counts, such as a weight of at most k."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).drop("_copy")


def replicate_many(df: DataFrame, copies: Column, key: str = "question_id") -> DataFrame:
    """Same for counts that grow with the data.

    A row is first split into parts of at most COPIES_PER_TASK_ROW copies and the parts are spread
    over the tasks, so the copies of one row are not all written by one task. The number of
    partitions is given because the parts are small before they are copied, and adaptive execution
    would otherwise merge them again.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.sequence(F.lit(0), F.floor((copies - 1) / COPIES_PER_TASK_ROW))
    spread = (
        df.withColumn("_copies", copies.cast("long")).filter("_copies > 0")
        .withColumn("_part", F.explode(parts))
        .repartition(partitions, key, "_part")
    )
    here = F.least(F.col("_copies") - F.col("_part") * COPIES_PER_TASK_ROW, F.lit(COPIES_PER_TASK_ROW))
    return replicate(spread, here).drop("_copies", "_part")


def distinct_answers(graded: DataFrame) -> DataFrame:
    """Keep one candidate per question and SQL text, the lowest-numbered."""
    rest = [name for name in graded.columns if name not in ("question_id", "predicted_sql")]
    ordered = ["candidate_idx", *[name for name in rest if name != "candidate_idx"]]
    return (
        graded.groupBy("question_id", "predicted_sql").agg(F.min(F.struct(*ordered)).alias("kept"))
        .select("question_id", "predicted_sql", *[f"kept.{name}" for name in rest])
    )


def choose_target(questions: DataFrame, first: DataFrame) -> DataFrame:
    """Answer to train on: the model's own first correct SQL, else the gold SQL."""
    found = first.select("question_id", F.col("predicted_sql").alias("correct_sql"))
    has_own = F.coalesce(F.col("correct_sql"), F.lit("")) != ""
    return questions.join(found, "question_id", "left").select(
        *questions.columns,
        F.when(has_own, F.col("correct_sql")).otherwise(F.col("gold_sql")).alias("target_sql"),
        F.when(has_own, "star").otherwise("injected").alias("origin"),
    )


def sft_from_correct(correct: DataFrame, resample: bool = True) -> DataFrame:
    """Training rows of correct candidates, repeated by difficulty weight."""
    prompt = format_prompt(F.col("question"), F.col("schema_text"))
    weight = F.col("difficulty_weight") if resample else F.lit(1)
    rows = replicate(correct.select("question_id", "question", "schema_text", "predicted_sql", weight.alias("_w")), F.col("_w"))
    return rows.select(
        "question_id", F.lit("correct").alias("origin"), *sft_prompt_as_instruction(prompt, F.col("predicted_sql"))
    )


def inject_gold(failed: DataFrame) -> DataFrame:
    """Gold training rows of unsolved questions, one per failed candidate."""
    prompt = format_prompt(F.col("question"), F.col("schema_text"))
    rows = replicate_many(
        failed.select("question_id", "question", "schema_text", "gold_sql", "n_failures"), F.col("n_failures")
    )
    return rows.select(
        "question_id", F.lit("injected").alias("origin"), *sft_prompt_as_instruction(prompt, F.col("gold_sql"))
    )


def sft_from_targets(targets: DataFrame) -> DataFrame:
    prompt = format_prompt(F.col("question"), F.col("schema_text"))
    return targets.select("question_id", "origin", *sft_prompt_as_input(prompt, F.col("target_sql")))


def training_gate(sft: DataFrame, min_rows: int = MIN_TRAINING_ROWS) -> DataFrame:
    return sft.agg(F.count("*").alias("n_rows")).withColumn("train", F.col("n_rows") >= min_rows)


def mix_summary(
    graded: DataFrame, sft: DataFrame, min_rows: int = MIN_TRAINING_ROWS, questions: DataFrame | None = None
) -> DataFrame:
    """One row: questions and candidates graded, training rows by origin, and whether to train.

    With `questions`, those that were never graded count as failed.
    """
    per_question = question_stats(graded, questions).select(F.col("n_correct").alias("n"))
    tagged = per_question.select("n", F.lit("question").alias("origin")).unionByName(
        sft.select(F.lit(0).cast("long").alias("n"), "origin")
    )
    of = {name: F.col("origin") == name for name in ("question", "correct", "injected")}
    return tagged.agg(
        F.count_if(of["question"]).alias("train_total"),
        F.count_if(of["question"] & (F.col("n") > 0)).alias("train_correct"),
        F.count_if(of["question"] & (F.col("n") == 0)).alias("failed_questions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("correct_candidates"),
        F.count_if(of["correct"]).alias("sft_examples"),
        F.count_if(of["injected"]).alias("injected_examples"),
        F.count_if(~of["question"]).alias("total_training_examples"),
    ).select(
        "*",
        ratio(F.col("train_correct"), F.col("train_total")).alias("train_accuracy"),
        (F.col("total_training_examples") >= min_rows).alias("train"),
    )


def retrain_summary(targets: DataFrame) -> DataFrame:
    return targets.agg(
        F.count("*").alias("total_errors"),
        F.count_if(F.col("origin") == "star").alias("star_count"),
        F.count_if(F.col("origin") == "injected").alias("injection_count"),
    ).select(
        "*",
        ratio(F.col("star_count"), F.col("total_errors")).alias("star_ratio"),
        ratio(F.col("injection_count"), F.col("total_errors")).alias("injection_ratio"),
    )
