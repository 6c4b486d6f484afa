"""One question, one statement and one database hold a third of all rows."""

import pytest
from pyspark.sql import functions as F

from sqlcurate.operators.questions import attach_schema, pass_at_k
from sqlcurate.operators.results import fingerprint_results, mark_truncated, match_results
from sqlcurate.plans.evaluation import evaluate_first_correct, evaluate_vote
from sqlcurate.plans.grading import grade
from sqlcurate.plans.training import build_training_set

N = 240_000
HOT = N // 3


@pytest.fixture(scope="module")
def skewed(spark):
    """Question 0 has a third of the candidates; half of all candidates share execution 1.

    Executions: 0 gold, 1 equal to gold as a set only, 2 other, 3 failed. Question 0 is answered
    with 3 and 2 only, the others with 1 and 2.
    """
    n = F.col("id")
    hot = n % 3 == 0
    rank = F.floor(n / 3)
    candidates = spark.range(N).select(
        F.when(hot, 0).otherwise(1 + n % 997).alias("question_id"),
        (1 + rank).cast("int").alias("candidate_idx"),
        F.lit("because").alias("reasoning"),
        F.concat(F.lit("SELECT "), n.cast("string")).alias("predicted_sql"),
        F.when(hot, F.when(rank % 4 == 0, 2).otherwise(3)).otherwise(F.when(rank % 4 == 0, 2).otherwise(1)).alias("exec_id"),
    )
    questions = spark.range(998).select(
        F.col("id").alias("question_id"), F.lit("db").alias("db_id"), F.lit("q").alias("question"),
        F.lit("SELECT 1").alias("gold_sql"), F.lit(0).alias("gold_exec_id"),
    )
    executions = spark.createDataFrame(
        [(0, True, None), (1, True, None), (2, True, None), (3, False, "no such table: t")], "exec_id int, ok boolean, error string"
    )
    rows = spark.range(N).select(
        F.when(n % 3 == 0, 0).when(n % 3 == 1, 1).otherwise(2).alias("exec_id"), rank.alias("row_no"),
        F.when(n % 3 == 1, F.array((rank % 100).cast("string"), F.lit("X")))
        .when(n % 3 == 0, F.array(F.lit("x"), (rank % 100).cast("string"))).otherwise(F.array(F.lit("y"))).alias("vals"),
    )
    return questions, candidates, executions, rows


@pytest.fixture(scope="module")
def prints(skewed):
    _, _, executions, rows = skewed
    return fingerprint_results(rows, executions)


def test_large_results(skewed, prints, spark):
    _, _, executions, rows = skewed
    got = {row.exec_id: row for row in prints.collect()}
    assert got[0].set_print == got[1].set_print != got[2].set_print and got[0].bag_print != got[1].bag_print
    assert [got[i].n_rows for i in range(4)] == [HOT, HOT, HOT, 0]
    pairs = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 0)], "pair_id int, pred_exec_id int, gold_exec_id int")
    matched = {row.pair_id: (row.n_pred, row.n_gold, row.is_match) for row in match_results(rows, pairs).collect()}
    assert matched == {1: (100, 100, True), 2: (1, 100, False), 3: (0, 100, False)}
    assert mark_truncated(executions, rows, 50_000).filter("truncated").count() == 3


def test_verdicts(skewed, prints):
    questions, candidates, *_ = skewed
    first = evaluate_first_correct(questions, candidates, prints)
    assert first.filter("NOT is_correct").select("question_id").collect()[0][0] == 0 and first.filter("is_correct").count() == 997
    vote = {row.question_id: row for row in evaluate_vote(questions, candidates, prints).collect()}
    assert (vote[0].vote_count, vote[0].total_candidates, vote[0].is_correct) == (HOT // 4, HOT, False)
    assert sum(row.total_candidates for row in vote.values()) == N


def test_training_set(skewed, prints, spark):
    questions, candidates, *_ = skewed
    graded = grade(questions, candidates, prints)
    assert pass_at_k(graded).first().correct == 997
    schemas = spark.createDataFrame([("db", "S")], "db_id string, schema_text string")
    assert attach_schema(questions, schemas).filter("schema_text = 'S'").count() == 998
    sft = build_training_set(questions, graded, schemas, k=8)
    counts = {row.origin: row["count"] for row in sft.groupBy("origin").count().collect()}
    correct = graded.filter("is_correct").count()
    assert counts == {"correct": correct, "injected": HOT}
    largest = sft.filter("origin = 'injected'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest <= HOT / 2
