"""Grading, training sets and reports as whole jobs."""

from pyspark.sql import functions as F

from demo import views as V
from demo.catalogs import DUCK_NATION, DUCK_TOP, nation_catalog, nation_values, star_catalog, star_session
from demo.expressions import PROMPT
from demo.questions import graded
from demo.registry import query
from sqlcurate.functions.prompting import PROMPT_HEAD, PROMPT_MIDDLE, PROMPT_TAIL, SYSTEM_PROMPT
from sqlcurate.operators import curation, questions as Q, reports
from sqlcurate.plans.evaluation import evaluate_first_correct
from sqlcurate.plans.grading import weigh
from sqlcurate.plans.progress import progress_report
from sqlcurate.plans.prompts import build_prompts, prompts_of
from sqlcurate.plans.training import build_retrain_set, build_training_set, retrain_targets
from sqlcurate.sources import readers, writers
from sqlcurate.sources.storage import scratch_path

WEIGHT = "CASE WHEN n_correct = 0 THEN 8 ELSE greatest(1, 8 - n_correct) END"
# Orders without lines are questions that nobody answered: eight failures each.
ASKED_STATS = """
    , asked AS (SELECT question_id, coalesce(n_correct, 0) AS n_correct, coalesce(n_total, 8) AS n_total FROM lq LEFT JOIN gstat USING (question_id))"""
COPIES = ASKED_STATS + f"""
    , copies AS (SELECT question_id, 'correct' AS origin, predicted_sql AS output, unnest(range(0, {WEIGHT})) AS n
                 FROM g JOIN gstat USING (question_id) WHERE is_correct
                 UNION ALL SELECT question_id, 'injected', gold_sql, unnest(range(0, n_total))
                 FROM lq JOIN asked USING (question_id) WHERE n_correct = 0)"""


def training_set(spark, sf, **options):
    return build_training_set(
        V.line_questions(spark, sf), V.graded_lines(spark, sf), V.schemas(spark, sf), V.K, **options
    )


@query("x2_replicate", COPIES + """
    SELECT question_id, output, count(*) AS n_copies FROM copies WHERE origin = 'correct' GROUP BY ALL""")
def x2(spark, sf):
    weighted = Q.correct_only(weigh(V.graded_lines(spark, sf), V.K))
    copies = curation.replicate(weighted, F.col("difficulty_weight"))
    return copies.groupBy("question_id", F.col("predicted_sql").alias("output")).agg(F.count("*").alias("n_copies"))


@query("x3_inject_gold", COPIES + f"""
    SELECT question_id, {PROMPT} AS instruction, output, count(*) AS n_copies
    FROM copies JOIN lq USING (question_id) LEFT JOIN schemas USING (db_id) WHERE origin = 'injected' GROUP BY ALL""")
def x3(spark, sf):
    asked = Q.attach_schema(V.line_questions(spark, sf), V.schemas(spark, sf))
    injected = curation.inject_gold(asked.join(Q.unsolved(V.graded_lines(spark, sf), asked, V.K), "question_id"))
    return injected.groupBy("question_id", "instruction", "output").agg(F.count("*").alias("n_copies"))


@query("u1_training_union", COPIES + "SELECT origin, count(*) AS n_rows, count(DISTINCT question_id) AS n_questions FROM copies GROUP BY origin")
def u1(spark, sf):
    return training_set(spark, sf).groupBy("origin").agg(
        F.count("*").alias("n_rows"), F.countDistinct("question_id").alias("n_questions")
    )


@query("a11_mix_summary", COPIES + """
    SELECT count(*) AS train_total, count(*) FILTER (WHERE n_correct > 0) AS train_correct,
           count(*) FILTER (WHERE n_correct = 0) AS failed_questions, sum(n_correct)::BIGINT AS correct_candidates,
           (SELECT count(*) FROM copies WHERE origin = 'correct') AS sft_examples,
           (SELECT count(*) FROM copies WHERE origin = 'injected') AS injected_examples,
           (SELECT count(*) FROM copies) AS total_training_examples,
           count(*) FILTER (WHERE n_correct > 0) / count(*) AS train_accuracy, (SELECT count(*) FROM copies) >= 100 AS train
    FROM asked""")
def a11(spark, sf):
    return curation.mix_summary(V.graded_lines(spark, sf), training_set(spark, sf), questions=V.line_questions(spark, sf))


BEST = "arg_min(predicted_sql, (candidate_idx, predicted_sql))"
TARGETS = f"""
    , best AS (SELECT question_id, {BEST} AS s FROM g WHERE is_correct GROUP BY question_id),
    target AS (SELECT question_id, coalesce(s, gold_sql) AS target_sql, CASE WHEN s IS NULL THEN 'injected' ELSE 'star' END AS origin
               FROM lq LEFT JOIN best USING (question_id))"""


@query("a12_retrain_summary", TARGETS + """
    SELECT count(*) AS total_errors, count(*) FILTER (WHERE origin = 'star') AS star_count,
           count(*) FILTER (WHERE origin = 'injected') AS injection_count,
           count(*) FILTER (WHERE origin = 'star') / count(*) AS star_ratio,
           count(*) FILTER (WHERE origin = 'injected') / count(*) AS injection_ratio FROM target""")
def a12(spark, sf):
    chosen = curation.choose_target(V.line_questions(spark, sf), Q.first_correct(V.graded_lines(spark, sf)))
    return curation.retrain_summary(chosen)


@query("c2_grade", """
    , n AS (SELECT question_id, count(*) FILTER (WHERE is_correct) AS n FROM verdict GROUP BY question_id)
    SELECT question_id, candidate_idx, db_id, question, reasoning, predicted_sql, gold_sql, is_correct, pred_error AS error_message,
           (CASE WHEN n = 0 THEN 8 ELSE greatest(1, 8 - n) END)::INTEGER AS difficulty_weight
    FROM verdict JOIN n USING (question_id)""")
def c2(spark, sf):
    return weigh(graded(spark, sf), V.K).select(
        "question_id", "candidate_idx", "db_id", "question", "reasoning", "predicted_sql", "gold_sql",
        "is_correct", "error_message", "difficulty_weight",
    )


FIRST = """
    , hit AS (SELECT question_id, min(candidate_idx) AS candidate_idx FROM verdict WHERE is_correct GROUP BY question_id),
    out AS (SELECT q.question_id, q.db_id, q.question, q.gold_sql, h.candidate_idx IS NOT NULL AS is_correct,
                   CASE WHEN g.ok THEN c.predicted_sql END AS predicted_sql, h.candidate_idx,
                   CASE WHEN h.candidate_idx IS NOT NULL THEN c.reasoning END AS reasoning,
                   CASE WHEN NOT g.ok THEN 'Gold SQL failed to execute'
                        WHEN h.candidate_idx IS NULL THEN 'No correct candidate found' END AS error,
                   NOT g.ok AS gold_error
            FROM q JOIN exec g ON g.exec_id = q.gold_exec_id LEFT JOIN hit h ON h.question_id = q.question_id
            JOIN cand c ON c.question_id = q.question_id AND c.candidate_idx = coalesce(h.candidate_idx, 1))"""


def first_correct_verdicts(spark, sf):
    return evaluate_first_correct(V.questions(spark, sf), V.candidates(spark, sf), V.prints(spark, sf))


@query("c3_evaluate_first_correct", FIRST + "SELECT * FROM out")
def c3(spark, sf):
    return first_correct_verdicts(spark, sf)


@query("a10_run_summary", FIRST + """
    SELECT 'dev' AS split, 8 AS k_candidates, 'first_correct' AS strategy, count(*) AS total,
           count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM out""")
def a10(spark, sf):
    return reports.run_summary(first_correct_verdicts(spark, sf), split="dev", k_candidates=V.K, strategy="first_correct")


@query("c6_build_training_set", COPIES + f"""
    SELECT question_id, origin, {PROMPT} AS instruction, '' AS input, output
    FROM copies JOIN lq USING (question_id) LEFT JOIN schemas USING (db_id)""")
def c6(spark, sf):
    return training_set(spark, sf)


@query("c6_build_training_set_deduped", ASKED_STATS + f"""
    , one AS (SELECT DISTINCT question_id, predicted_sql FROM g WHERE is_correct)
    SELECT question_id, origin, {PROMPT} AS instruction, '' AS input, output FROM (
        SELECT question_id, 'correct' AS origin, predicted_sql AS output FROM one
        UNION ALL SELECT question_id, 'injected', gold_sql FROM (
            SELECT question_id, gold_sql, unnest(range(0, n_total)) FROM lq JOIN asked USING (question_id) WHERE n_correct = 0))
    JOIN lq USING (question_id) LEFT JOIN schemas USING (db_id)""")
def c6_deduped(spark, sf):
    return training_set(spark, sf, resample=False, dedupe=True)


KNOWN = "lq.db_id NOT IN ('nation_25', 'nation_26')"


def _errors(spark, sf):
    """Questions of known databases, written to an errors file and read from it."""
    known = V.line_questions(spark, sf).join(V.schemas(spark, sf).select("db_id"), "db_id", "left_semi")
    path = scratch_path(spark, "errors")
    writers.write_errors(known.withColumn("is_correct", F.lit(False)), path)
    return readers.load_errors(spark, path).select(F.col("question_id").cast("long").alias("question_id"), "db_id", "question", "gold_sql")


def _with_gold(spark, sf):
    return V.graded_lines(spark, sf).withColumn("gold_ok", F.col("question_id") % 10 != 3)


@query("c7_build_retrain_set", TARGETS + f"""
    SELECT question_id, origin, '{SYSTEM_PROMPT}' AS instruction,
           '{PROMPT_HEAD}' || schema_text || '{PROMPT_MIDDLE}' || question || '{PROMPT_TAIL}' AS input, target_sql AS output
    FROM target JOIN lq USING (question_id) JOIN schemas USING (db_id)""")
def c7(spark, sf):
    return build_retrain_set(_errors(spark, sf), _with_gold(spark, sf), V.schemas(spark, sf))


@query("c7_retrain_targets", TARGETS + f"""
    SELECT t.question_id, t.target_sql, t.origin, CASE WHEN n_total IS NOT NULL THEN t.question_id % 10 = 3 END AS gold_error
    FROM target t JOIN lq USING (question_id) LEFT JOIN gstat USING (question_id) WHERE {KNOWN}""")
def c7_targets(spark, sf):
    targets = retrain_targets(_errors(spark, sf), _with_gold(spark, sf), V.schemas(spark, sf))
    return targets.select("question_id", "target_sql", "origin", "gold_error")


@query("c8_build_prompts", DUCK_NATION + f"""
    SELECT question_id, '{PROMPT_HEAD}' || schema_text || '{PROMPT_MIDDLE}' || question || '{PROMPT_TAIL}' AS prompt, 2 AS n_messages
    FROM q JOIN texts USING (db_id)""")
def c8(spark, sf):
    prompts = build_prompts(V.questions(spark, sf), nation_catalog(spark, sf), nation_values(spark, sf))
    return prompts.select("question_id", "prompt", F.size("messages").alias("n_messages"))


STAR_DDL = " UNION ALL ".join(
    f"SELECT {t} AS table_idx, 'CREATE TABLE {table} ({', '.join(columns)})' AS ddl" for t, (table, columns) in enumerate(V.STAR_CATALOG.items())
)


@query("c8_prompts_of", DUCK_TOP + f"""
    , per_column AS (SELECT table_idx, column_idx, column_name || ': ' || string_agg(preview, ', ' ORDER BY value_rank) AS line
                     FROM kept GROUP BY table_idx, column_idx, column_name),
    per_table AS (SELECT table_idx, string_agg(line, '; ' ORDER BY column_idx) AS line FROM per_column GROUP BY table_idx),
    star AS (SELECT string_agg(ddl || coalesce(chr(10) || '-- Sample values: ' || line, ''), chr(10) || chr(10) ORDER BY table_idx) AS schema_text
             FROM ({STAR_DDL}) LEFT JOIN per_table USING (table_idx))
    SELECT question_id, '{PROMPT_HEAD}' || schema_text || '{PROMPT_MIDDLE}' || question || '{PROMPT_TAIL}' AS prompt, 2 AS n_messages FROM q, star""")
def c8_of(spark, sf):
    """Two databases with equal tables, each asked half of the questions."""
    names = ["star_0", "star_1"]
    questions = V.questions(spark, sf).withColumn("db_id", V.text("star_", F.col("question_id") % 2))
    catalog = star_catalog(spark).withColumn("db_id", F.explode(F.array(*map(F.lit, names))))
    prompts = prompts_of(questions, catalog, {name: star_session(spark, sf) for name in names})
    return prompts.select("question_id", "prompt", F.size("messages").alias("n_messages"))


GAIN = "train_accuracy - coalesce(lag(train_accuracy) OVER (ORDER BY iteration), 0.0) AS improvement"
NEW_BEST = "dev_accuracy > coalesce(max(dev_accuracy) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS is_new_best"
FIRST_BEST = "SELECT iteration, dev_accuracy FROM hist ORDER BY dev_accuracy DESC, iteration LIMIT 1"


@query("w3_improvement", f"SELECT iteration, train_accuracy, {GAIN} FROM hist")
def w3(spark, sf):
    return reports.improvement(V.history(spark, sf)).select("iteration", "train_accuracy", "improvement")


@query("w4_running_best", f"SELECT iteration, dev_accuracy, {NEW_BEST} FROM hist")
def w4(spark, sf):
    return reports.running_best(V.history(spark, sf)).select("iteration", "dev_accuracy", "is_new_best")


@query("a15_best_iteration", FIRST_BEST)
def a15(spark, sf):
    return reports.best_iteration(V.history(spark, sf))


@query("c9_progress_report", f"""
    SELECT iteration, train_accuracy, dev_accuracy, {GAIN}, {NEW_BEST},
           iteration = (SELECT iteration FROM ({FIRST_BEST})) AS is_best FROM hist""")
def c9(spark, sf):
    return progress_report(V.history(spark, sf)).select(
        "iteration", "train_accuracy", "dev_accuracy", "improvement", "is_new_best", "is_best"
    )
