"""Training sets of an iteration and of a retraining on errors."""

from pyspark.sql import DataFrame, functions as F

from sqlcurate.functions.scoring import difficulty_weight
from sqlcurate.operators.curation import (
    choose_target, distinct_answers, inject_gold, sft_from_correct, sft_from_targets,
)
from sqlcurate.operators.questions import attach_schema, correct_only, first_correct, question_stats
from sqlcurate.plans.grading import DEFAULT_K

ASKED = ["question_id", "db_id", "question", "gold_sql"]


def build_training_set(
    questions: DataFrame, graded: DataFrame, schemas: DataFrame,
    k: int = DEFAULT_K, resample: bool = True, dedupe: bool = False,
) -> DataFrame:
    """`(question_id, origin, instruction, input, output)`: correct candidates and injected gold.

    Correct candidates are repeated by difficulty, gold SQL of unsolved questions once per failed
    candidate, or k times if there is no candidate. `dedupe` keeps one candidate per question and SQL text.
    """
    answers = graded.select("question_id", "candidate_idx", "predicted_sql", "is_correct")
    counted = question_stats(answers, questions, k).select(
        "question_id", "n_correct", F.col("n_total").alias("n_failures"),
        difficulty_weight(F.col("n_correct"), k).alias("difficulty_weight"),
    )
    # Everything per question is settled before candidates, which may be many, are joined last.
    asked = attach_schema(questions.select(*ASKED).join(counted, "question_id"), schemas)
    correct = correct_only(answers)
    if dedupe:
        correct = distinct_answers(correct)
    return sft_from_correct(correct.join(asked, "question_id"), resample).unionByName(
        inject_gold(asked.filter("n_correct = 0"))
    )


def retrain_targets(errors: DataFrame, graded: DataFrame, schemas: DataFrame) -> DataFrame:
    """What to train on for each question of an errors file; an unknown database fails the job."""
    gold = graded.groupBy("question_id").agg((~F.bool_or("gold_ok")).alias("gold_error"))
    asked = attach_schema(errors, schemas, strict=True).join(gold, "question_id", "left")
    return choose_target(asked, first_correct(graded))


def build_retrain_set(errors: DataFrame, graded: DataFrame, schemas: DataFrame) -> DataFrame:
    return sft_from_targets(retrain_targets(errors, graded, schemas))
