"""Work that has to spread over tasks, whatever the size that Spark guesses for its input."""

import json

from pyspark.sql import functions as F

from demo import views as V
from sqlcurate.operators import questions as Q
from sqlcurate.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_broadcast(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "question_id long, db_id string")
    responses = spark.createDataFrame([(1, ["SELECT 1", "SELECT 2"]), (3, ["SELECT 3"])], "question_id long, candidates array<string>")
    joined = Q.attach_candidates(questions, Q.parse_candidates(Q.explode_candidates(responses)), 2)
    rows = sorted((r.db_id, r.candidate_idx, r.predicted_sql) for r in joined.collect())
    assert rows == [("a", 1, "SELECT 1"), ("a", 2, "SELECT 2"), ("b", 1, ""), ("b", 2, ""), ("c", 1, ""), ("c", 2, "")]
    assert "BroadcastExchange" not in plan(joined)


def test_replies_are_searched_once(spark):
    replies = spark.createDataFrame([(1, "SELECT 1;"), (2, "none"), (3, None)], "question_id long, response string")
    kept = Q.non_blank(Q.parse_candidates(replies))
    assert [tuple(r) for r in kept.collect()] == [(1, "SELECT 1;", "SELECT 1")]
    filters = [line for line in plan(kept).split("Filter")[1:]]
    assert filters and not any("regexp_extract" in f.split("+-")[0] for f in filters)


def test_customers_are_dealt_to_all_tasks(spark, tmp_path):
    """A table of one row group is read by one task."""
    spark.range(400).selectExpr("id AS c_custkey", "'x' AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = V.candidates(spark, str(tmp_path)).withColumn("part", F.spark_partition_id())
    assert made.count() == 400 * V.K
    assert made.select("part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert V.executions(spark, str(tmp_path)).groupBy("exec_id").count().filter("count = 1").count() == 400 * (V.K + 1)


def test_training_rows_are_written_compressed(spark, tmp_path):
    """Copies of a row take no room of their own."""
    rows = spark.range(20_000).selectExpr("concat('Which orders did ', id % 10, ' place?') AS instruction", "'' AS input", "'SELECT 1' AS output")
    writers.write_sft(rows.coalesce(1), f"{tmp_path}/sft")
    text = spark.read.text(f"{tmp_path}/sft")
    assert text.count() == 20_000 and sorted(map(repr, spark.read.json(f"{tmp_path}/sft").distinct().collect())) == sorted(map(repr, rows.distinct().select("input", "instruction", "output").collect()))
    assert sum(f.stat().st_size for f in (tmp_path / "sft").iterdir()) * 10 < text.selectExpr("sum(length(value))").first()[0]


def test_errors_are_parsed_once(spark, tmp_path):
    entries = [{"question": "a", "db_id": "d", "gold_sql": "s"}, {"question": "a", "db_id": "d", "gold_sql": "s"}, {"question_id": "x", "question": "b"}]
    (tmp_path / "errors.json").write_text(json.dumps({"errors": {"SYNTAX": entries}}) + "\n" + json.dumps(entries[2:]) + "\n")
    errors = readers.load_errors(spark, f"{tmp_path}/errors.json", layout="documents")
    got = errors.collect()
    assert sorted((r.question, r.error_category or "") for r in got) == [("a", "SYNTAX"), ("a", "SYNTAX"), ("b", ""), ("b", "SYNTAX")]
    assert [r.question_id for r in got if r.question == "b"] == ["x", "x"] and len({r.question_id for r in got}) == 3
    assert "from_json" not in plan(errors)
