"""F*, J*, A1-A3, A14, A16, L*, W1, W2, X1: questions, candidates and verdicts per question."""

from pyspark.sql import functions as F

from demo import views as V
from demo.registry import query
from sqlcurate.operators import curation, questions as Q, reports, sampling
from sqlcurate.operators.results import cap_rows, mark_truncated, match_results
from sqlcurate.plans.grading import grade


def graded(spark, sf):
    return grade(V.questions(spark, sf), V.candidates(spark, sf), V.prints(spark, sf))


@query("f1_correct_only", "SELECT question_id, candidate_idx, predicted_sql FROM g WHERE is_correct")
def f1(spark, sf):
    return Q.correct_only(V.graded_lines(spark, sf)).select("question_id", "candidate_idx", "predicted_sql")


@query("f2_wrong_only", "SELECT question_id, candidate_idx, predicted_sql FROM g WHERE NOT is_correct")
def f2(spark, sf):
    return Q.wrong_only(V.graded_lines(spark, sf)).select("question_id", "candidate_idx", "predicted_sql")


@query("f3_non_blank", "SELECT question_id, candidate_idx, predicted_sql FROM cand WHERE predicted_sql <> ''")
def f3(spark, sf):
    return Q.non_blank(V.candidates(spark, sf)).select("question_id", "candidate_idx", "predicted_sql")


@query("f4_executed_only", "SELECT question_id, candidate_idx, answer FROM g WHERE ok")
def f4(spark, sf):
    return Q.executed_only(V.graded_lines(spark, sf)).select("question_id", "candidate_idx", "answer")


@query("f5_of_split", "SELECT question_id, db_id, question FROM q WHERE split = 'dev'")
def f5(spark, sf):
    return Q.of_split(V.questions(spark, sf), "dev").select("question_id", "db_id", "question")


@query("f6_flag_gold_errors", """
    SELECT question_id, coalesce(bool_or(is_correct), false) AS is_correct, NOT bool_or(gold_ok) AS gold_error,
           CASE WHEN NOT bool_or(gold_ok) THEN 'Gold SQL failed to execute' END AS error
    FROM verdict GROUP BY question_id""")
def f6(spark, sf):
    per_question = graded(spark, sf).groupBy("question_id").agg(
        F.bool_or("is_correct").alias("is_correct"), F.bool_or("gold_ok").alias("gold_ok")
    )
    flagged = Q.flag_gold_errors(per_question.withColumn("error", F.lit(None).cast("string")))
    return flagged.select("question_id", "is_correct", "gold_error", "error")


@query("f8_training_gate", """
    SELECT n AS n_rows, n >= 100 AS train FROM (SELECT count(*) AS n FROM g WHERE is_correct)""")
def f8(spark, sf):
    return curation.training_gate(Q.correct_only(V.graded_lines(spark, sf)))


@query("j1_attach_candidates", """
    SELECT question_id, db_id, candidate_idx, predicted_sql FROM lq JOIN g USING (question_id)
    UNION ALL SELECT question_id, db_id, 1, '' FROM lq ANTI JOIN g USING (question_id)""")
def j1(spark, sf):
    joined = Q.attach_candidates(V.line_questions(spark, sf), V.graded_lines(spark, sf))
    return joined.select("question_id", "db_id", "candidate_idx", "predicted_sql")


@query("j2_attach_schema", """
    SELECT question_id, db_id, coalesce(schema_text, '') AS schema_text FROM lq LEFT JOIN schemas USING (db_id)""")
def j2(spark, sf):
    joined = Q.attach_schema(V.line_questions(spark, sf), V.schemas(spark, sf))
    return joined.select("question_id", "db_id", "schema_text")


@query("j3_attach_schema_strict", "SELECT question_id, db_id, schema_text FROM q JOIN schemas USING (db_id)")
def j3(spark, sf):
    joined = Q.attach_schema(V.questions(spark, sf), V.schemas(spark, sf), strict=True)
    return joined.select("question_id", "db_id", "schema_text")


def pairs(spark, sf):
    return V.candidates(spark, sf).select(
        F.col("exec_id").alias("pair_id"),
        F.col("exec_id").alias("pred_exec_id"),
        (F.col("question_id") * 16).alias("gold_exec_id"),
    )


@query("j4_match_results", """
    SELECT p.exec_id AS pair_id, g.n_keys AS n_gold, p.n_keys AS n_pred,
           len(list_intersect(p.row_set, g.row_set)) AS n_both, p.row_set = g.row_set AS is_match
    FROM sets p JOIN sets g ON g.exec_id = p.question_id * 16 WHERE p.slot > 0""")
def j4(spark, sf):
    matched = match_results(V.exec_rows(spark, sf), pairs(spark, sf))
    return matched.select("pair_id", "n_gold", "n_pred", "n_both", "is_match")


@query("j5_pair_executions", """
    SELECT c.question_id, c.candidate_idx, p.ok AS pred_ok, g.ok AS gold_ok, p.error AS pred_error
    FROM cand c JOIN exec p ON p.exec_id = c.exec_id JOIN exec g ON g.exec_id = c.question_id * 16""")
def j5(spark, sf):
    paired = Q.pair_executions(V.questions(spark, sf), V.candidates(spark, sf), V.prints(spark, sf))
    return paired.select("question_id", "candidate_idx", "pred_ok", "gold_ok", "pred_error")


@query("j6_unsolved", "SELECT question_id, n_total AS n_failures FROM gstat WHERE n_correct = 0")
def j6(spark, sf):
    return Q.unsolved(V.graded_lines(spark, sf))


@query("j7_choose_target", """
    , best AS (SELECT question_id, arg_min(predicted_sql, (candidate_idx, predicted_sql)) AS s FROM g WHERE is_correct GROUP BY question_id)
    SELECT question_id, coalesce(s, gold_sql) AS target_sql, CASE WHEN s IS NULL THEN 'injected' ELSE 'star' END AS origin
    FROM lq LEFT JOIN best USING (question_id)""")
def j7(spark, sf):
    chosen = curation.choose_target(V.line_questions(spark, sf), Q.first_correct(V.graded_lines(spark, sf)))
    return chosen.select("question_id", "target_sql", "origin")


@query("a1_question_stats", "SELECT question_id, n_correct, n_total FROM gstat")
def a1(spark, sf):
    return Q.question_stats(V.graded_lines(spark, sf))


@query("a2_pass_at_k", """
    SELECT count(*) AS total, count(*) FILTER (WHERE n_correct > 0) AS correct,
           count(*) FILTER (WHERE n_correct > 0) / count(*) AS accuracy FROM gstat""")
def a2(spark, sf):
    return Q.pass_at_k(V.graded_lines(spark, sf))


@query("a2_pass_at_k_unanswered", """
    SELECT count(*) AS total, count(*) FILTER (WHERE n_correct > 0 AND question_id % 7 <> 0) AS correct,
           count(*) FILTER (WHERE n_correct > 0 AND question_id % 7 <> 0) / count(*) AS accuracy FROM lq LEFT JOIN gstat USING (question_id)""")
def a2_unanswered(spark, sf):
    return Q.pass_at_k(V.graded_lines(spark, sf).filter("question_id % 7 <> 0"), V.line_questions(spark, sf))


@query("j6_unsolved_unanswered", """
    SELECT question_id, CASE WHEN question_id % 7 = 0 OR n_total IS NULL THEN 8 ELSE n_total END AS n_failures
    FROM lq LEFT JOIN gstat USING (question_id) WHERE question_id % 7 = 0 OR coalesce(n_correct, 0) = 0""")
def j6_unanswered(spark, sf):
    return Q.unsolved(V.graded_lines(spark, sf).filter("question_id % 7 <> 0"), V.line_questions(spark, sf), V.K)


@query("j1_attach_unanswered", """
    SELECT q.question_id, c.candidate_idx, c.predicted_sql FROM q JOIN cand c USING (question_id) WHERE q.question_id % 6 <> 1
    UNION ALL SELECT question_id, unnest(range(1, 9)), '' FROM q WHERE question_id % 6 = 1""")
def j1_unanswered(spark, sf):
    some = V.candidates(spark, sf).filter("question_id % 6 <> 1")
    return Q.attach_candidates(V.questions(spark, sf), some, V.K).select("question_id", "candidate_idx", "predicted_sql")


@query("a3_candidate_accuracy", """
    SELECT count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct,
           count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM g""")
def a3(spark, sf):
    return Q.candidate_accuracy(V.graded_lines(spark, sf))


@query("a14_dataset_stats", """
    SELECT split, count(*) AS n_rows, count(DISTINCT db_id) AS n_dbs FROM q GROUP BY split
    UNION ALL SELECT 'total', count(*), count(DISTINCT db_id) FROM q""")
def a14(spark, sf):
    return reports.dataset_stats(V.questions(spark, sf))


POSITIONS = """
    , hit AS (SELECT question_id, min(candidate_idx) FILTER (WHERE is_correct) AS candidate_idx FROM g GROUP BY question_id),
    pos AS (SELECT candidate_idx, count(*) AS n_correct FROM hit WHERE candidate_idx IS NOT NULL GROUP BY candidate_idx)"""


def line_verdicts(spark, sf):
    lines = V.graded_lines(spark, sf)
    return lines.select("question_id").distinct().join(Q.first_correct(lines), "question_id", "left").select(
        "question_id", "candidate_idx", F.col("candidate_idx").isNotNull().alias("is_correct")
    )


@query("a16_correct_by_position", POSITIONS + "SELECT candidate_idx, n_correct FROM pos")
def a16(spark, sf):
    return reports.correct_by_position(line_verdicts(spark, sf))


@query("w2_cumulative_by_position", POSITIONS + """
    SELECT candidate_idx, n_correct, (sum(n_correct) OVER (ORDER BY candidate_idx))::BIGINT AS cumulative,
           sum(n_correct) OVER (ORDER BY candidate_idx) / (SELECT count(*) FROM hit) AS share
    FROM pos""")
def w2(spark, sf):
    return reports.cumulative_by_position(line_verdicts(spark, sf))


@query("w1_first_correct", """
    SELECT question_id, candidate_idx, predicted_sql FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY candidate_idx, predicted_sql) AS k FROM g WHERE is_correct)
    WHERE k = 1""")
def w1(spark, sf):
    return Q.first_correct(V.graded_lines(spark, sf))


@query("x1_explode_candidates", "SELECT question_id, candidate_idx, response FROM reply")
def x1(spark, sf):
    return Q.explode_candidates(V.responses(spark, sf))


@query("l1_sample_n", """
    SELECT question_id FROM lq ORDER BY md5('7' || question_id), question_id LIMIT 500""")
def l1(spark, sf):
    return sampling.sample_n(V.line_questions(spark, sf), 500, seed="7").select("question_id")


@query("l1_sample_large", """
    SELECT question_id FROM lq ORDER BY md5('7' || question_id), question_id LIMIT 12000""")
def l1_large(spark, sf):
    return sampling.sample_n(V.line_questions(spark, sf), 12_000, seed="7").select("question_id")


@query("l2_fixed_sample", """
    , fixed AS (SELECT question_id FROM lq ORDER BY md5('0' || question_id), question_id LIMIT 700)
    SELECT question_id, n_correct FROM fixed JOIN gstat USING (question_id)""")
def l2(spark, sf):
    fixed = sampling.sample_n(V.line_questions(spark, sf), 700).select("question_id")
    return fixed.join(Q.question_stats(V.graded_lines(spark, sf)), "question_id").select("question_id", "n_correct")


@query("l3_restore_order", "SELECT question_id, candidate_idx, is_correct FROM verdict ORDER BY question_id, candidate_idx")
def l3(spark, sf):
    shuffled = graded(spark, sf).select("question_id", "candidate_idx", "is_correct").repartition("candidate_idx", "question_id")
    return Q.restore_order(shuffled)


@query("w5_cap_rows", """
    SELECT exec_id, row_no FROM (SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY row_no) AS k FROM rows_)
    WHERE k <= 5""")
def w5(spark, sf):
    return cap_rows(V.exec_rows(spark, sf), cap=5, dense=False).select("exec_id", "row_no")


@query("w5_mark_truncated", """
    SELECT exec_id, least(n_rows, 5) AS n_kept, n_rows > 5 AS truncated,
           CASE WHEN n_rows > 5 THEN 'Results truncated to 5 rows' ELSE error END AS error FROM sets""")
def w5_marks(spark, sf):
    marked = mark_truncated(V.executions(spark, sf), V.exec_rows(spark, sf), cap=5)
    return marked.select("exec_id", "n_kept", "truncated", "error")
