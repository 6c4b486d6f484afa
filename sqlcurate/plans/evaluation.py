"""Verdicts per question under the two evaluation strategies."""

from pyspark.sql import DataFrame, functions as F

from sqlcurate.operators.questions import flag_gold_errors, of_split, with_gold, with_result
from sqlcurate.operators.reports import run_summary
from sqlcurate.operators.sampling import sample_n
from sqlcurate.operators.votes import majority_vote, vote_counts
from sqlcurate.sources.storage import stored

QUESTION = ["question_id", "db_id", "question", "gold_sql"]


def evaluate_first_correct(questions: DataFrame, candidates: DataFrame, prints: DataFrame) -> DataFrame:
    """pass@k: a question is correct if any candidate is; the lowest-numbered one is reported.

    Candidates are first reduced to one per question and result. Those meet gold on question and
    result together, so the candidates of one question never have to be in one task.
    """
    asked = with_gold(questions, prints)
    answers = with_result(candidates, prints).select(
        "question_id", "candidate_idx", "predicted_sql", "reasoning",
        F.when(F.col("pred_ok"), F.col("pred_set_print")).alias("result"),
    )
    per_result = vote_counts(answers, carry=("reasoning",))
    hits = per_result.filter("result IS NOT NULL").select(
        "question_id", F.col("result").alias("gold_set_print"), F.col("first").alias("hit")
    )
    opening = per_result.groupBy("question_id").agg(F.min("first").alias("opening"))
    matched = (
        asked.filter("gold_ok").select("question_id", "gold_set_print")
        .join(hits, ["question_id", "gold_set_print"]).select("question_id", "hit")
    )
    found = asked.join(matched, "question_id", "left").join(opening, "question_id", "left")
    hit = F.col("hit").isNotNull()
    verdicts = found.select(
        *QUESTION, "gold_ok",
        hit.alias("is_correct"),
        F.when(hit, F.col("hit.predicted_sql"))
        .when(F.col("gold_ok"), F.coalesce("opening.predicted_sql", F.lit(""))).alias("predicted_sql"),
        F.col("hit.candidate_idx").alias("candidate_idx"),
        F.col("hit.reasoning").alias("reasoning"),
        F.when(~hit, "No correct candidate found").alias("error"),
    )
    return flag_gold_errors(verdicts).drop("gold_ok")


def evaluate_vote(questions: DataFrame, candidates: DataFrame, prints: DataFrame, strict: bool = False) -> DataFrame:
    """Self-consistency: the most frequent result is the answer.

    Votes are counted on multisets of rows. The winner is compared with gold as a set of rows, or
    as the same multiset under `strict`. Only winners meet the questions.
    """
    votes = with_result(candidates, prints).select(
        "question_id", "candidate_idx", "predicted_sql", F.col("pred_set_print").alias("set_print"),
        F.when(F.col("pred_ok"), F.col("pred_bag_print")).alias("result"),
    )
    winners = majority_vote(votes, carry=("set_print",))
    same = (
        F.col("result") == F.col("gold_bag_print") if strict else F.col("set_print") == F.col("gold_set_print")
    )
    voted = F.col("vote_count").isNotNull()
    verdicts = with_gold(questions, prints).join(winners, "question_id", "left").select(
        *QUESTION, "gold_ok",
        (voted & F.coalesce(same, F.lit(False))).alias("is_correct"),
        F.when(F.col("gold_ok"), F.coalesce("predicted_sql", "opening_sql", F.lit(""))).alias("predicted_sql"),
        F.when(F.col("gold_ok"), F.col("vote_count")).alias("vote_count"),
        F.when(F.col("gold_ok") & voted, F.col("total_candidates")).alias("total_candidates"),
        F.when(~voted, "No valid SQL execution").alias("error"),
    )
    return flag_gold_errors(verdicts).drop("gold_ok")


def run_evaluation(
    questions: DataFrame, candidates: DataFrame, prints: DataFrame,
    split: str = "dev", strategy: str = "self_consistency", sample_size: int = 0, seed: str = "0", **config,
) -> tuple[DataFrame, DataFrame]:
    """`(summary, verdicts)` of one run over a split, or over a fixed sample of it.

    Verdicts are made once, and stored. `strategy` is `self_consistency` or `first_correct`; `config` values become summary columns.
    """
    evaluate = {"self_consistency": evaluate_vote, "first_correct": evaluate_first_correct}[strategy]
    asked = sample_n(of_split(questions, split), sample_size, seed)
    verdicts = stored(evaluate(asked, candidates, prints), "verdicts")
    return run_summary(verdicts, split=split, strategy=strategy, **config), verdicts
