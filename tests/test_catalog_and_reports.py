import json

import pytest
from pyspark.sql import functions as F

from sqlcurate.plans.prompts import prompts_of, sample_values
from sqlcurate.sources import readers
from sqlcurate.operators import catalog as C, reports as R
from sqlcurate import schemas
from sqlcurate.plans.progress import iteration_record, progress_report
from sqlcurate.plans.prompts import build_prompts
from sqlcurate.sources.readers import load_catalog, load_history
from sqlcurate.sources.writers import append_history


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    """Two databases as one JSON document, with the `*` entry and a table without columns."""
    path = tmp_path_factory.mktemp("catalog") / "tables.json"
    path.write_text(json.dumps([
        {
            "db_id": "shop",
            "table_names_original": ["users", "visits"],
            "column_names_original": [[-1, "*"], [0, "id"], [0, "name"], [1, "User_ID"], [0, "city"], [1, "day"], [0, "age"], [0, "mail"], [7, "lost"]],
        },
        {"db_id": "bare", "table_names_original": ["t"], "column_names_original": [[-1, "*"]]},
    ]))
    return load_catalog(spark, str(path), document=True)


def test_load_catalog(catalog):
    rows = sorted((r.db_id, r.table_idx, r.table_name, r.column_idx, r.column_name) for r in catalog.filter("db_id = 'shop'").collect())
    assert rows == [
        ("shop", 0, "users", 0, "id"), ("shop", 0, "users", 1, "name"), ("shop", 0, "users", 2, "city"),
        ("shop", 0, "users", 3, "age"), ("shop", 0, "users", 4, "mail"),
        ("shop", 1, "visits", 0, "User_ID"), ("shop", 1, "visits", 1, "day"),
    ]


def test_sampleable_columns(catalog):
    assert sorted(row.column_name for row in C.sampleable_columns(catalog).collect()) == ["age", "city", "day", "name"]


def test_schema_text(spark, catalog):
    texts = {row.db_id: row.schema_text for row in C.render_schemas(catalog).collect()}
    assert texts == {
        "shop": "CREATE TABLE users (id, name, city, age, mail)\n\nCREATE TABLE visits (User_ID, day)",
        "bare": "CREATE TABLE t ()",
    }


def test_schema_text_with_samples(spark, catalog):
    users = spark.createDataFrame(
        [(i, None, f"city {i % 5} with a very long name", i % 3) for i in range(10)], "id int, name string, city string, age int"
    )
    visits = spark.createDataFrame([(1, None)], "User_ID int, day string")
    columns = C.sampleable_columns(catalog.filter("db_id = 'shop'")).collect()
    values = C.column_values({"users": users, "visits": visits}, columns)
    top = C.top_values(values)
    texts = {row.db_id: row.schema_text for row in C.render_schemas(catalog, top).collect()}
    assert texts["shop"] == (
        "CREATE TABLE users (id, name, city, age, mail)\n"
        "-- Sample values: city: city 0 with a very l, city 1 with a very l, city 2 with a very l; age: 0, 1, 2\n\n"
        "CREATE TABLE visits (User_ID, day)"
    )
    questions = spark.createDataFrame([(1, "shop", "How many?")], "question_id long, db_id string, question string")
    row = build_prompts(questions, catalog, values).first()
    assert texts["shop"] in row.prompt and row.messages[1].content == row.prompt


def test_top_values_are_the_first_distinct_ones(spark):
    values = spark.range(1000).select(
        F.lit("d").alias("db_id"), F.lit(0).alias("table_idx"), F.lit("t").alias("table_name"), F.lit(0).alias("column_idx"),
        F.lit("c").alias("column_name"), F.format_string("%03d", F.col("id") % 100).alias("value"),
    )
    got = sorted((row.value_rank, row.value) for row in C.top_values(values).collect())
    assert got == [(1, "000"), (2, "001"), (3, "002")]


HISTORY = "iteration int, train_accuracy double, dev_accuracy double"


def test_progress(spark):
    history = spark.createDataFrame([(1, 0.5, 0.7), (2, 0.6, 0.8), (3, 0.55, 0.8), (4, 0.7, None)], HISTORY)
    rows = {row.iteration: row for row in progress_report(history).collect()}
    assert [round(rows[i].improvement, 6) for i in (1, 2, 3, 4)] == [0.5, 0.1, -0.05, 0.15]
    assert [rows[i].is_new_best for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert [rows[i].is_best for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert R.last_state(history).first().iteration == 4


def test_no_history(spark):
    empty = spark.createDataFrame([], HISTORY)
    assert R.best_iteration(empty).count() == R.last_state(empty).count() == progress_report(empty).count() == 0


def test_positions(spark):
    verdicts = spark.createDataFrame(
        [(True, 1), (True, 3), (True, None), (False, None), (True, 3)], "is_correct boolean, candidate_idx int"
    )
    assert sorted(tuple(row) for row in R.correct_by_position(verdicts).collect()) == [(1, 2), (3, 2)]
    assert sorted(tuple(row) for row in R.cumulative_by_position(verdicts).collect()) == [(1, 2, 2, 0.4), (3, 2, 4, 0.8)]


def test_run_summary(spark):
    verdicts = spark.createDataFrame([(True,), (False,), (True,), (True,)], "is_correct boolean")
    assert R.run_summary(verdicts, split="dev").first().asDict() == {"split": "dev", "total": 4, "correct": 3, "accuracy": 0.75}
    assert R.run_summary(verdicts.limit(0)).first().accuracy == 0.0


def test_dataset_stats(spark):
    questions = spark.createDataFrame([("train", "a"), ("train", "b"), ("dev", "a")], "split string, db_id string")
    assert {tuple(row) for row in R.dataset_stats(questions).collect()} == {("train", 2, 2), ("dev", 1, 1), ("total", 3, 2)}


def test_iteration_record_fits_the_history(spark, tmp_path):
    mix = spark.createDataFrame(
        [(3, 1, 2, 2, 4, 3, 7, 1 / 3, False)],
        "train_total long, train_correct long, failed_questions long, correct_candidates long, sft_examples long,"
        " injected_examples long, total_training_examples long, train_accuracy double, train boolean",
    )
    dev = R.run_summary(spark.createDataFrame([(True,), (False,)], "is_correct boolean"))
    for iteration in (1, 2):
        append_history(iteration_record(iteration, mix, dev), f"{tmp_path}/history")
    last = R.last_state(load_history(spark, f"{tmp_path}/history")).first()
    assert (last.iteration, last.train_correct, last.dev_accuracy, last.total_training_examples) == (2, 1, 0.5, 7)
    assert last.ts is not None


def test_values_of_databases_as_they_are(spark, tmp_path):
    """Other case, a dot in a name, a missing column, a missing table, a database with nothing to show."""
    spark.createDataFrame([("x", 1.0), ("y", None)], "`a.b` string, Size double").write.parquet(f"{tmp_path}/Boats.parquet")
    session = readers.register_database(readers.new_database_session(spark), str(tmp_path), ["Boats"])
    rows = [("d", 0, "boats", 0, "A.B"), ("d", 0, "boats", 1, "size"), ("d", 0, "boats", 2, "gone"), ("d", 1, "ports", 0, "name"), ("e", 0, "boats", 0, "id")]
    catalog = spark.createDataFrame(rows, "db_id string, table_idx int, table_name string, column_idx int, column_name string")
    got = sample_values(catalog, {"d": session, "e": session})
    assert sorted((r.db_id, r.column_name, r.preview) for r in got.collect()) == [("d", "A.B", "x"), ("d", "A.B", "y"), ("d", "size", "1.0")]
    questions = spark.createDataFrame([(1, "d", "Which?")], "question_id long, db_id string, question string")
    assert "A.B: x, y; size: 1.0" in prompts_of(questions, catalog, {"d": session}).first()["prompt"]


def test_an_iteration_is_kept_once_however_often_it_is_appended(spark, tmp_path):
    path = f"{tmp_path}/again"
    rows = lambda *some: spark.createDataFrame([(i, 0.5, 1, 2, d, 1, 0, 1, None) for i, d in some], schemas.HISTORY)
    for some in ([(1, 0.5)], [(2, 0.7)], [(2, 0.6)], [(3, 0.9), (1, 0.55)], [(3, 0.8)], [(3, 0.8)]):
        append_history(rows(*some), path)
    history = load_history(spark, path)
    assert history.schema == schemas.HISTORY
    assert sorted((r.iteration, r.dev_accuracy) for r in history.collect()) == [(1, 0.55), (2, 0.6), (3, 0.8)]
    assert R.last_state(history).first().iteration == 3
    assert [r.is_new_best for r in R.running_best(history).orderBy("iteration").collect()] == [True, True, True]


def test_values_of_many_databases_take_as_many_jobs_as_of_few(spark):
    def jobs(n):
        sessions, rows = {}, []
        for i in range(n):
            sessions[f"d{i}"] = readers.new_database_session(spark)
            sessions[f"d{i}"].createDataFrame([(f"x{i}", i), (f"y{i}", i)], f"name string, size{i} int").createOrReplaceTempView("t")
            rows += [(f"d{i}", 0, "t", 0, "name"), (f"d{i}", 0, "t", 1, f"size{i}")]
        catalog = spark.createDataFrame(rows, "db_id string, table_idx int, table_name string, column_idx int, column_name string")
        before = spark._jsc.sc().dagScheduler().nextJobId()
        values = C.database_values(catalog, sessions)
        asked = spark._jsc.sc().dagScheduler().nextJobId() - before
        return asked, sorted((r.db_id, r.column_name, r.value) for r in values.collect())

    few, many = jobs(3), jobs(200)
    assert few[0] == many[0] <= 2
    assert many[1] == sorted(row for i in range(200) for row in [(f"d{i}", "name", f"x{i}"), (f"d{i}", "name", f"y{i}"), *[(f"d{i}", f"size{i}", str(i))] * 2])
