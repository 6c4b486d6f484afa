"""Majority votes over equal results.

A vote row is `(question_id, candidate_idx, predicted_sql, result)`, one per candidate; `result` is
any key that is equal for equal results, or NULL for a candidate that may not vote. Further columns
named in `carry` follow the first candidate of a group.
"""

from pyspark.sql import DataFrame, functions as F


def vote_counts(votes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates per question and result, with the first candidate that gave the result."""
    return votes.groupBy("question_id", "result").agg(
        F.count("*").alias("votes"),
        F.min(F.struct("candidate_idx", "predicted_sql", *carry)).alias("first"),
    )


def majority_vote(votes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Winning result per question. Between equally many votes the result seen first wins.

    A question without a single vote has NULLs and the SQL of its first candidate in `opening_sql`.
    """
    ballot = F.struct("votes", (-F.col("first.candidate_idx")).alias("_order"), "first", "result")
    return (
        vote_counts(votes, carry).groupBy("question_id").agg(
            F.max(F.when(F.col("result").isNotNull(), ballot)).alias("w"),
            F.sum("votes").alias("total_candidates"),
            F.min("first").alias("opening"),
        )
        .select(
            "question_id",
            F.col("w.votes").alias("vote_count"),
            F.col("w.result").alias("result"),
            "w.first.*",
            "total_candidates",
            F.col("opening.predicted_sql").alias("opening_sql"),
        )
    )
