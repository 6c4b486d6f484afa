"""Counts, votes and verdicts per question."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sqlcurate.functions.scoring import difficulty_weight, failed_generation, fill_candidates, gold_of, ratio
from sqlcurate.operators import questions as Q
from sqlcurate.operators.results import fingerprint_results
from sqlcurate.operators.votes import majority_vote, vote_counts
from sqlcurate.plans.evaluation import evaluate_first_correct, evaluate_vote
from sqlcurate.plans.grading import grade, weigh


def test_difficulty_weight(column):
    weight = lambda v: difficulty_weight(v.cast("long"), 4)
    assert column(weight, ["0", "1", "3", "4", "9"]) == [4, 3, 1, 1, 1]


def test_ratio(column):
    assert column(lambda v: ratio(F.lit(1), v.cast("long")), ["0", "4"]) == [0.0, 0.25]


def test_gold_of(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("", "b"), (None, None)], "gold_sql string, query string")
    assert [row[0] for row in df.select(gold_of(df)).collect()] == ["a", "b", "", ""]
    assert [row[0] for row in df.select(gold_of(df.select("query"))).collect()] == ["b", "b", "b", ""]


def test_fill_candidates(spark):
    df = spark.createDataFrame([(None,), ([],), (["x", None],)], "c array<string>")
    assert [row[0] for row in df.select(fill_candidates(F.col("c"))).collect()] == [[""], [""], ["x", ""]]
    assert spark.range(1).select(failed_generation(3)).first()[0] == ["", "", ""]


def test_explode_and_parse(spark):
    df = spark.createDataFrame([(1, ["SELECT 1;", None]), (2, None)], "question_id long, candidates array<string>")
    rows = Q.parse_candidates(Q.explode_candidates(df)).collect()
    assert sorted((row.question_id, row.candidate_idx, row.predicted_sql) for row in rows) == [(1, 1, "SELECT 1"), (1, 2, ""), (2, 1, "")]


def test_attach_schema(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "question_id long, db_id string")
    schemas = spark.createDataFrame([("a", "A")], "db_id string, schema_text string")
    rows = {row.question_id: row.schema_text for row in Q.attach_schema(questions, schemas).collect()}
    assert rows == {1: "A", 2: "", 3: ""}
    known = Q.attach_schema(questions.filter("question_id = 1"), schemas, strict=True)
    assert [row.schema_text for row in known.collect()] == ["A"]
    with pytest.raises(PySparkException, match="unknown database: b"):
        Q.attach_schema(questions, schemas, strict=True).collect()


def test_text_keyed(spark):
    rows = [(1, "one", "q"), (2, "two", "q"), (3, "three", "r")]
    df = spark.createDataFrame(rows, "question_id long, db_id string, question string")
    assert sorted((row.question, row.question_id, row.db_id) for row in Q.text_keyed(df).collect()) == [("q", 2, "two"), ("r", 3, "three")]


VOTES = "question_id long, candidate_idx int, predicted_sql string, result string"


def test_majority(spark):
    votes = spark.createDataFrame([
        (1, 1, "s1", "x"), (1, 2, "s2", "y"), (1, 3, "s3", "y"),
        # A tie goes to the result that was seen first.
        (2, 1, "s1", None), (2, 2, "s2", "y"), (2, 3, "s3", "x"), (2, 4, "s4", "x"), (2, 5, "s5", "y"),
        # Nobody may vote.
        (3, 1, "first", None), (3, 2, "second", None),
    ], VOTES)
    won = {row.question_id: row for row in majority_vote(votes.repartition(4)).collect()}
    assert (won[1].vote_count, won[1].result, won[1].predicted_sql, won[1].total_candidates) == (2, "y", "s2", 3)
    assert (won[2].vote_count, won[2].result, won[2].predicted_sql, won[2].total_candidates) == (2, "y", "s2", 5)
    assert (won[3].vote_count, won[3].result, won[3].opening_sql, won[3].total_candidates) == (None, None, "first", 2)


def test_vote_counts(spark):
    votes = spark.createDataFrame([(1, 2, "b", "x"), (1, 1, "a", "x"), (1, 3, "c", "y")], VOTES)
    got = {row.result: (row.votes, row["first"].candidate_idx, row["first"].predicted_sql) for row in vote_counts(votes).collect()}
    assert got == {"x": (2, 1, "a"), "y": (1, 3, "c")}


@pytest.fixture(scope="module")
def run(spark):
    """Five questions with the result of each candidate; None is a failed execution."""
    a, b, aa, empty = [("A",)], [("b",)], [("a",), ("a",)], []
    gold = {1: a, 2: a, 3: None, 4: a, 5: empty}
    replies = {
        1: [b, aa, a, aa],      # strict vote: aa, which is gold as a set only
        2: [b, b, a],           # the vote is wrong, the third candidate is right
        3: [a],                 # gold fails
        4: [None, None],        # nothing runs
        5: [empty, None],       # an empty result matches an empty gold result
    }
    executions, rows, questions, candidates = [], [], [], []

    def add(result):
        key = len(executions)
        executions.append((key, result is not None, None if result is not None else "no such column: x"))
        rows.extend((key, n, list(row)) for n, row in enumerate(result or []))
        return key

    for question, result in gold.items():
        questions.append((question, "db", f"q{question}", f"gold{question}", add(result)))
        for idx, reply in enumerate(replies[question], start=1):
            candidates.append((question, idx, "because", f"s{question}{idx}", add(reply)))
    candidates.append((5, 3, "because", " ", add(empty)))  # blank SQL never counts, even if said to have run
    questions.append((6, "db", "q6", "gold6", add(a)))  # a question without candidates
    prints = fingerprint_results(
        spark.createDataFrame(rows, "exec_id long, row_no long, vals array<string>"),
        spark.createDataFrame(executions, "exec_id long, ok boolean, error string"),
    )
    return (
        spark.createDataFrame(questions, "question_id long, db_id string, question string, gold_sql string, gold_exec_id long"),
        spark.createDataFrame(candidates, "question_id long, candidate_idx int, reasoning string, predicted_sql string, exec_id long"),
        prints,
    )


def test_grade(run):
    graded = {(row.question_id, row.candidate_idx): row for row in weigh(grade(*run), k=8).collect()}
    correct = [key for key, row in graded.items() if row.is_correct]
    assert sorted(correct) == [(1, 2), (1, 3), (1, 4), (2, 3), (5, 1)]
    assert {key: graded[key].difficulty_weight for key in [(1, 1), (2, 1), (3, 1), (4, 1)]} == {(1, 1): 5, (2, 1): 7, (3, 1): 8, (4, 1): 8}
    assert graded[5, 3].error_message == "Empty SQL query" and graded[4, 1].error_message == "no such column: x"


def test_first_correct(run):
    got = {row.question_id: row for row in evaluate_first_correct(*run).collect()}
    assert {key: (row.is_correct, row.candidate_idx, row.predicted_sql) for key, row in got.items()} == {
        1: (True, 2, "s12"), 2: (True, 3, "s23"), 3: (False, None, None), 4: (False, None, "s41"), 5: (True, 1, "s51"), 6: (False, None, ""),
    }
    assert got[3].gold_error and got[3].error == "Gold SQL failed to execute"
    assert got[4].error == "No correct candidate found" and not got[4].gold_error
    assert got[1].reasoning == "because" and got[1].error is None


@pytest.mark.parametrize("strict, right", [(False, {1, 5}), (True, {5})])
def test_vote(run, strict, right):
    got = {row.question_id: row for row in evaluate_vote(*run, strict=strict).collect()}
    assert {key for key, row in got.items() if row.is_correct} == right
    assert (got[1].predicted_sql, got[1].vote_count, got[1].total_candidates) == ("s12", 2, 4)
    assert (got[2].predicted_sql, got[2].vote_count) == ("s21", 2)
    assert (got[3].predicted_sql, got[3].gold_error, got[3].vote_count) == (None, True, None)
    assert (got[4].predicted_sql, got[4].error, got[4].total_candidates) == ("s41", "No valid SQL execution", None)
    assert got[6].predicted_sql == ""


def test_verdicts_do_not_depend_on_partitioning(run):
    questions, candidates, prints = run
    for evaluate in (evaluate_first_correct, evaluate_vote):
        plain = sorted(map(str, evaluate(questions, candidates, prints).collect()))
        shuffled = evaluate(questions.repartition(3), candidates.repartition(5), prints.repartition(2))
        assert sorted(map(str, shuffled.collect())) == plain


def test_pass_at_k_is_at_least_vote_accuracy(run):
    first = evaluate_first_correct(*run).filter("is_correct").count()
    assert first >= evaluate_vote(*run).filter("is_correct").count()


def test_solved_and_unsolved_are_all_questions(run):
    graded = grade(*run)
    summary = Q.pass_at_k(graded).first()
    assert summary.correct + Q.unsolved(graded).count() == summary.total == 6  # one of them unanswered
    accuracy = Q.candidate_accuracy(graded).first()
    assert (accuracy.correct, accuracy.total) == (5, graded.count())


@pytest.mark.parametrize("others", [[], [1], [1, None], [None], [2, 2, 5, 9], [7]])
def test_not_in_is_that_of_sql(spark, others):
    rows = spark.createDataFrame([(k, f"r{i}") for i, k in enumerate([1, 2, 2, None, 3, None, 9])], "key int, name string")
    some = spark.createDataFrame([(o,) for o in others], "key int")
    rows.createOrReplaceTempView("not_in_rows")
    some.createOrReplaceTempView("not_in_others")
    want = spark.sql("SELECT * FROM not_in_rows WHERE key NOT IN (SELECT key FROM not_in_others)").collect()
    got = Q.not_in(rows, "key", some)
    assert sorted(got.collect(), key=str) == sorted(want, key=str)
    plan = got.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight, true" not in plan
