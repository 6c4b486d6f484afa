import pytest
from pyspark.sql import functions as F

from sqlcurate.functions.prompting import SYSTEM_PROMPT, chat_messages, format_prompt
from sqlcurate.operators import curation
from sqlcurate.operators.sampling import sample_n
from sqlcurate.plans.grading import weigh
from sqlcurate.plans.training import build_retrain_set, build_training_set, retrain_targets

SCHEMA_TEXT = "CREATE TABLE boats (no, name, port)"


@pytest.mark.parametrize("question, schema", [
    ("Which boats lie in the port of 'Esens'?", SCHEMA_TEXT),
    ("A {brace}, a \\ and\ntwo lines?", SCHEMA_TEXT + "\n\nCREATE TABLE ports (no)"),
    ("Nothing known?", ""),
])
def test_format_prompt(column, question, schema):
    [prompt] = column(lambda v: format_prompt(v, F.lit(schema)), [question])
    assert question in prompt and schema in prompt and prompt.endswith("SQL:")
    assert prompt.index("schema:\n\n" + schema) < prompt.index("Question: " + question)


def test_system_prompt():
    assert SYSTEM_PROMPT and "SQLite" in SYSTEM_PROMPT


def test_chat_messages(column):
    [messages] = column(chat_messages, ["ask"])
    assert [(message.role, message.content) for message in messages] == [("system", SYSTEM_PROMPT), ("user", "ask")]


@pytest.fixture(scope="module")
def data(spark):
    questions = spark.createDataFrame(
        [(1, "a", "q1", "g1"), (2, "a", "q2", "g2"), (3, "zzz", "q3", "g3")],
        "question_id long, db_id string, question string, gold_sql string",
    )
    graded = spark.createDataFrame([
        (1, 1, "s", True, True), (1, 2, "s", True, True), (1, 3, "t", False, True),
        (2, 1, "u", False, True), (2, 2, "v", False, True), (3, 1, "w", False, False),
    ], "question_id long, candidate_idx int, predicted_sql string, is_correct boolean, gold_ok boolean")
    schemas = spark.createDataFrame([("a", "A")], "db_id string, schema_text string")
    return questions, graded, schemas


def counted(df):
    rows = df.groupBy("question_id", "origin", "output").count().collect()
    return {(row.question_id, row.origin, row.output): row["count"] for row in rows}


def test_training_set(data):
    sft = build_training_set(*data, k=4)
    assert counted(sft) == {(1, "correct", "s"): 4, (2, "injected", "g2"): 2, (3, "injected", "g3"): 1}
    row = sft.filter("question_id = 2").first()
    assert row.input == "" and "q2" in row.instruction and "\n\nA\n\n" in row.instruction


def test_training_set_without_resampling_and_without_repeats(data):
    assert counted(build_training_set(*data, k=4, resample=False))[1, "correct", "s"] == 2
    assert counted(build_training_set(*data, k=4, resample=False, dedupe=True))[1, "correct", "s"] == 1


def test_copies_add_up_to_weights(data):
    questions, graded, schemas = data
    weights = weigh(graded, 4).filter("is_correct").agg(F.sum("difficulty_weight")).first()[0]
    assert build_training_set(*data, k=4).filter("origin = 'correct'").count() == weights


def test_mix_summary(data):
    questions, graded, schemas = data
    row = curation.mix_summary(graded, build_training_set(*data, k=4), min_rows=7).first()
    assert (row.train_total, row.train_correct, row.failed_questions, row.correct_candidates) == (3, 1, 2, 2)
    assert (row.sft_examples, row.injected_examples, row.total_training_examples, row.train) == (4, 3, 7, True)
    assert row.train_accuracy == pytest.approx(1 / 3)


def test_training_gate(spark):
    assert [curation.training_gate(spark.range(n)).first().train for n in (99, 100)] == [False, True]


def test_retrain_set(data):
    questions, graded, schemas = data
    errors = questions.filter("question_id < 3")
    targets = {row.question_id: row for row in retrain_targets(errors, graded, schemas).collect()}
    assert {key: (row.target_sql, row.origin, row.gold_error) for key, row in targets.items()} == {
        1: ("s", "star", False), 2: ("g2", "injected", False),
    }
    rows = {row.question_id: row for row in build_retrain_set(errors, graded, schemas).collect()}
    assert rows[1].instruction == SYSTEM_PROMPT and "q1" in rows[1].input and rows[1].output == "s"
    summary = curation.retrain_summary(retrain_targets(errors, graded, schemas)).first()
    assert (summary.total_errors, summary.star_count, summary.injection_count, summary.star_ratio) == (2, 1, 1, 0.5)


def test_many_copies_are_spread_over_tasks(spark):
    many = 10 * curation.COPIES_PER_TASK_ROW + 5
    df = spark.createDataFrame([(1, many), (2, 3), (3, 0)], "question_id long, n long")
    copies = curation.replicate_many(df, F.col("n"))
    assert {row.question_id: row["count"] for row in copies.groupBy("question_id").count().collect()} == {1: many, 2: 3}
    largest = copies.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < many / 2


@pytest.mark.parametrize("n", [1, 50, 10_000, 15_000, 19_999])
def test_sample_size_and_order(spark, n):
    """The first n rows of the seeded order."""
    df = spark.range(20_000).withColumnRenamed("id", "question_id")
    got = sorted(row.question_id for row in sample_n(df, n, seed="s").collect())
    ordered = df.orderBy(F.md5(F.concat(F.lit("s"), F.col("question_id").cast("string"))), "question_id").limit(n)
    assert got == sorted(row.question_id for row in ordered.collect()) and len(got) == n


def test_sample_of_all(spark):
    df = spark.range(30).withColumnRenamed("id", "question_id")
    assert sample_n(df, 0).count() == sample_n(df, 30).count() == sample_n(df, 99_999).count() == 30


def test_sample_is_repeatable(spark):
    df = spark.range(500).withColumnRenamed("id", "question_id")
    first, again = (sorted(r[0] for r in sample_n(x, 40, "1").collect()) for x in (df, df.repartition(7)))
    assert first == again != sorted(r[0] for r in sample_n(df, 40, "2").collect())
