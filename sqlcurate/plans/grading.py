"""Grading candidates against gold results."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlcurate.functions.scoring import difficulty_weight
from sqlcurate.operators.questions import (
    explode_candidates, pair_executions, parse_candidates, question_stats,
)
from sqlcurate.operators.results import fingerprint_results
from sqlcurate.plans.execution import exec_id, execute_statements
from sqlcurate.sources.storage import stored

DEFAULT_K = 8


def same_set() -> Column:
    """Both ran and gave equal sets of rows."""
    same = F.coalesce(F.col("pred_set_print") == F.col("gold_set_print"), F.lit(False))
    return F.col("pred_ok") & F.col("gold_ok") & same


def grade(questions: DataFrame, candidates: DataFrame, prints: DataFrame, k: int = 1) -> DataFrame:
    """One row per candidate with its verdict; an unanswered question has `k` empty, failed ones.

    `questions(question_id, db_id, question, gold_sql, gold_exec_id)`,
    `candidates(question_id, candidate_idx, reasoning, predicted_sql, exec_id)`, `prints` from
    `fingerprint_results`. As prints are looked up several times, store them first.
    """
    paired = pair_executions(questions, candidates, prints, k)
    return paired.select(
        *questions.columns,
        *[name for name in candidates.columns if name not in ("question_id", "exec_id")],
        "pred_exec_id", "pred_ok", "gold_ok",
        same_set().alias("is_correct"),
        F.col("pred_error").alias("error_message"),
    )


def weigh(graded: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Adds the difficulty weight of the question to each candidate.

    Verdicts are counted first, which takes two columns of `graded`, and the weights, one row per question, are stored.
    """
    weights = question_stats(graded).select(
        "question_id", difficulty_weight(F.col("n_correct"), k).alias("difficulty_weight")
    )
    return graded.join(stored(weights, "weights"), "question_id")


def execute_candidates(
    questions: DataFrame, responses: DataFrame, sessions: dict[str, SparkSession], **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From replies to what `grade` and the evaluations take: `(questions, candidates, prints)`.

    `questions(question_id, db_id, question, gold_sql)`, `responses(question_id, candidates)`.
    Gold and candidate statements are run together on `sessions`, each distinct one once; `options`
    go to `execute_statements`.
    """
    asked = questions.withColumn("gold_exec_id", exec_id(F.col("db_id"), F.col("gold_sql")))
    parsed = parse_candidates(explode_candidates(responses))
    located = questions.select("question_id", "db_id").join(parsed.hint("merge"), "question_id")  # as in attach_candidates
    candidates = stored(
        located.select(*parsed.columns, "db_id", exec_id(F.col("db_id"), F.col("predicted_sql")).alias("exec_id")), "candidates"
    )
    statements = questions.select("db_id", F.col("gold_sql").alias("sql")).unionByName(
        candidates.select("db_id", F.col("predicted_sql").alias("sql"))
    )
    executions, exec_rows = execute_statements(statements, sessions, **options)
    return asked, candidates.drop("db_id"), stored(fingerprint_results(exec_rows, executions), "prints")
