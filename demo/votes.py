"""Result fingerprints and votes."""

from pyspark.sql import functions as F

from demo import views as V
from demo.registry import query
from sqlcurate.functions.cells import row_key
from sqlcurate.operators.reports import run_summary
from sqlcurate.operators.results import match_results
from sqlcurate.operators.votes import majority_vote, vote_counts
from sqlcurate.plans.evaluation import evaluate_vote, run_evaluation


def _same_as(spark, sf, column):
    """First execution of the question whose print is equal: the print's classes, not its value."""
    prints = V.prints(spark, sf).withColumn("question_id", F.floor(F.col("exec_id") / 16))
    first = prints.groupBy("question_id", column).agg(F.min("exec_id").alias("same_as"))
    return prints.join(first, ["question_id", column]).select("exec_id", "n_rows", "same_as")


@query("a4_bag_fingerprint", """
    SELECT exec_id, n_rows, min(exec_id) OVER (PARTITION BY question_id, row_bag) AS same_as FROM sets""")
def a4(spark, sf):
    return _same_as(spark, sf, "bag_print")


@query("a4_set_fingerprint", """
    SELECT exec_id, n_rows, min(exec_id) OVER (PARTITION BY question_id, row_set) AS same_as FROM sets""")
def a4_sets(spark, sf):
    return _same_as(spark, sf, "set_print")


def line_votes(spark, sf):
    lines = V.graded_lines(spark, sf)
    return lines.select("question_id", "candidate_idx", "predicted_sql", F.when(F.col("ok"), F.col("answer")).alias("result"))


COUNTS = """
    , vc AS (SELECT question_id, answer AS result, count(*) AS votes, min(candidate_idx) AS first_idx,
                    arg_min(predicted_sql, (candidate_idx, predicted_sql)) AS sql
             FROM g WHERE ok GROUP BY question_id, answer),
    win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first_idx, sql DESC) AS k FROM vc)
            WHERE k = 1)"""


@query("a5_vote_counts", COUNTS + "SELECT question_id, result, votes, first_idx, sql FROM vc")
def a5(spark, sf):
    counts = vote_counts(line_votes(spark, sf).filter("result IS NOT NULL"))
    return counts.select(
        "question_id", "result", "votes", F.col("first.candidate_idx").alias("first_idx"), F.col("first.predicted_sql").alias("sql")
    )


@query("a6_majority_vote", COUNTS + """
    SELECT question_id, result, votes AS vote_count, sql AS predicted_sql, n_total AS total_candidates
    FROM gstat LEFT JOIN win USING (question_id)""")
def a6(spark, sf):
    return majority_vote(line_votes(spark, sf)).select(
        "question_id", "result", "vote_count", "predicted_sql", "total_candidates"
    )


@query("a7_vote_accuracy_strict", COUNTS + """
    SELECT count(*) AS total, count(*) FILTER (WHERE result = gold_answer) AS correct,
           count(*) FILTER (WHERE result = gold_answer) / count(*) AS accuracy
    FROM lq LEFT JOIN win USING (question_id)""")
def a7(spark, sf):
    winners = majority_vote(line_votes(spark, sf)).select("question_id", "result")
    same = F.coalesce(F.col("result") == F.col("gold_answer"), F.lit(False))
    verdicts = V.line_questions(spark, sf).join(winners, "question_id", "left").select(same.alias("is_correct"))
    return run_summary(verdicts)


VOTE = """
    , vc AS (SELECT question_id, pred_bag, any_value(pred_set) AS pred_set, count(*) AS votes, min(candidate_idx) AS first_idx,
                    arg_min(predicted_sql, candidate_idx) AS sql
             FROM verdict WHERE pred_ok GROUP BY question_id, pred_bag),
    win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first_idx) AS k FROM vc)
            WHERE k = 1),
    opening AS (SELECT question_id, arg_min(predicted_sql, candidate_idx) AS sql, count(*) AS n FROM cand GROUP BY question_id),
    out AS (SELECT q.question_id, q.db_id, q.question, q.gold_sql,
                   coalesce(g.ok AND win.{kind} = g.{gold}, false) AS is_correct,
                   CASE WHEN g.ok THEN coalesce(win.sql, opening.sql) END AS predicted_sql,
                   CASE WHEN g.ok THEN win.votes END AS vote_count,
                   CASE WHEN g.ok AND win.votes IS NOT NULL THEN opening.n END AS total_candidates,
                   CASE WHEN NOT g.ok THEN 'Gold SQL failed to execute'
                        WHEN win.votes IS NULL THEN 'No valid SQL execution' END AS error,
                   NOT g.ok AS gold_error
            FROM q JOIN sets g ON g.exec_id = q.gold_exec_id JOIN opening ON opening.question_id = q.question_id
            LEFT JOIN win ON win.question_id = q.question_id)"""
RELAXED = VOTE.format(kind="pred_set", gold="row_set")
STRICT = VOTE.format(kind="pred_bag", gold="row_bag")
SUMMARY = "SELECT count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM out"


def votes(spark, sf, strict):
    return evaluate_vote(V.questions(spark, sf), V.candidates(spark, sf), V.prints(spark, sf), strict)


@query("a8_vote_accuracy_relaxed", RELAXED + SUMMARY)
def a8(spark, sf):
    return run_summary(votes(spark, sf, strict=False))


@query("a9_no_valid_candidate", COUNTS + """
    , opening AS (SELECT question_id, arg_min(predicted_sql, (candidate_idx, predicted_sql)) AS opening_sql FROM g GROUP BY question_id)
    SELECT question_id, opening_sql FROM opening ANTI JOIN win USING (question_id)""")
def a9(spark, sf):
    winners = majority_vote(line_votes(spark, sf))
    return winners.filter("vote_count IS NULL").select("question_id", "opening_sql")


@query("c4_evaluate_vote_relaxed", RELAXED + "SELECT * FROM out")
def c4(spark, sf):
    return votes(spark, sf, strict=False)


@query("c5_evaluate_vote_strict", STRICT + "SELECT * FROM out")
def c5(spark, sf):
    return votes(spark, sf, strict=True)


@query("u2_distinct_rows", "SELECT DISTINCT exec_id, array_to_string(row_key, '|') AS row_key FROM keyed")
def u2(spark, sf):
    keys = V.exec_rows(spark, sf).select("exec_id", F.array_join(row_key(F.col("vals")), "|").alias("row_key"))
    return keys.distinct()


@query("u3_set_equality", """
    SELECT a.question_id, a.row_set = b.row_set AS first_equals_second
    FROM sets a JOIN sets b ON a.question_id = b.question_id AND a.slot = 1 AND b.slot = 2""")
def u3(spark, sf):
    pairs = V.questions(spark, sf).select(
        F.col("question_id").alias("pair_id"),
        (F.col("question_id") * 16 + 1).alias("pred_exec_id"),
        (F.col("question_id") * 16 + 2).alias("gold_exec_id"),
    )
    matched = match_results(V.exec_rows(spark, sf), pairs)
    return matched.select(F.col("pair_id").alias("question_id"), F.col("is_match").alias("first_equals_second"))


@query("c4_run_evaluation", RELAXED + """
    , run AS (SELECT * FROM out JOIN q USING (question_id) WHERE split = 'dev')
    SELECT 'dev' AS split, 'self_consistency' AS strategy, 8 AS k_candidates, count(*) AS total,
           count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM run""")
def c4_run(spark, sf):
    summary, _ = run_evaluation(
        V.questions(spark, sf), V.candidates(spark, sf), V.prints(spark, sf), k_candidates=V.K
    )
    return summary
