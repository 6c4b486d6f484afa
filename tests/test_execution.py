import time

import pytest
from pyspark.sql import functions as F

from sqlcurate.functions.text import error_class
from sqlcurate.plans import execution
from sqlcurate.plans.evaluation import run_evaluation
from sqlcurate.plans.execution import exec_id, execute_statements
from sqlcurate.plans.grading import execute_candidates, grade
from sqlcurate.sources.readers import new_database_session, register_database


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("db")
    boats = [(11, "Heron", 4.5), (12, "Otter", None), (13, "Tern", 9.25), (14, "Otter", 7.0)]
    spark.createDataFrame(boats, "no int, name string, length double").write.parquet(f"{folder}/boats.parquet")
    rows = [(1, "Ada", 41), (2, "Ben", 19), (3, "Cleo", None)]
    spark.createDataFrame(rows, "id int, name string, age int").write.parquet(f"{folder}/users.parquet")
    return register_database(new_database_session(spark), str(folder), ["users", "boats"])


def run(spark, users, *statements, **options):
    """Outcome and rows of each statement, in the order given."""
    frame = spark.createDataFrame([("db", sql) for sql in statements], "db_id string, sql string")
    executions, rows = execute_statements(frame, {"db": users}, **options)
    ids = [row[0] for row in frame.select(exec_id(F.col("db_id"), F.col("sql"))).collect()]
    outcomes = {row.exec_id: row for row in executions.collect()}
    results = {}
    for row in sorted(rows.collect(), key=lambda row: row.row_no):
        results.setdefault(row.exec_id, []).append(tuple(row.vals))
    return [(outcomes[i], results.get(i, [])) for i in ids]


def test_statements(spark, users):
    [(longest, rows), (none, missing), (twice, found), (nothing, _), (half, _), (unknown, _), (tail, counted)] = run(
        spark, users,
        "SELECT name, length FROM boats WHERE length > 5 ORDER BY length DESC", "SELECT length FROM boats WHERE no = 12",
        "SELECT name FROM boats GROUP BY name HAVING count(*) > 1", "\t \n", "SELECT name, FROM boats GROUP", "SELECT speed FROM ferries",
        "-- how many\nSELECT count(DISTINCT name) FROM boats; ",
    )
    assert longest.ok and longest.error is None and rows == [("Tern", "9.25"), ("Otter", "7.0")]
    assert none.ok and missing == [(None,)]
    assert twice.ok and found == [("Otter",)]
    assert tail.ok and counted == [("3",)]
    assert not nothing.ok and nothing.error == "Empty SQL query"
    assert not half.ok and "PARSE_SYNTAX_ERROR" in half.error
    assert not unknown.ok and "TABLE_OR_VIEW_NOT_FOUND" in unknown.error


def test_results_are_whole_without_a_cap(spark, users):
    same = run(spark, users, "SELECT id % 977 AS v FROM range(120000)", "SELECT id % 977 AS v FROM range(120000) ORDER BY v")
    assert [len(rows) for _, rows in same] == [120_000] * 2 and not any(outcome.truncated for outcome, _ in same)


def attempts_of(monkeypatch):
    """Folders that statements were written to, as they are."""
    tried, write = [], execution._written
    monkeypatch.setattr(execution, "_written", lambda plan, path, *rest: tried.append(path) or write(plan, path, *rest))
    return tried


def test_a_statement_that_analyses_is_tried_once(spark, users, monkeypatch):
    tried = attempts_of(monkeypatch)
    bad = ["SELECT CAST(name AS INT) FROM users", "SELECT 1 / (id - id) FROM users", "SELECT raise_error('no') FROM boats"]
    outcomes = run(spark, users, *[f"SELECT id + {n} FROM users" for n in range(40)], *bad, "SELECT FROM", "SELECT x FROM users", " ")
    assert [outcome.ok for outcome, _ in outcomes] == [True] * 40 + [False] * 6
    assert all(len(rows) == 3 for _, rows in outcomes[:40]) and not any(rows for _, rows in outcomes[40:])
    assert len(tried) == len(set(tried)) == 43


def test_a_failing_statement_only_marks_itself(spark, users):
    good, bad, bare, none = run(
        spark, users,
        "SELECT id FROM users", "SELECT CAST(name AS INT) FROM users", "SELECT name, count(*) FROM users", "SELECT id FROM users WHERE id > 9",
    )
    assert good[0].ok and sorted(good[1]) == [("1",), ("2",), ("3",)]
    assert not bad[0].ok and "CAST_INVALID_INPUT" in bad[0].error and bad[1] == []
    assert not bare[0].ok and "GROUP" in bare[0].error
    assert none[0].ok and none[1] == []


def test_order_and_cap(spark, users):
    [(outcome, rows)] = run(spark, users, "SELECT id FROM range(200) ORDER BY id DESC;", cap=50)
    assert outcome.ok and outcome.truncated and outcome.n_kept == 50 and "truncated to 50" in outcome.error
    assert rows == [(str(number),) for number in range(199, 149, -1)]


def test_equal_names_and_number_forms(spark, users):
    [(_, rows)] = run(
        spark, users,
        "SELECT a.id, b.id, a.id / 2, CAST(1e7 AS DOUBLE), 0.5D FROM users a JOIN users b ON a.id = b.id WHERE a.id = 2",
    )
    assert rows == [("2", "2", "1.0", "10000000.0", "0.5")]


@pytest.mark.parametrize("sql", [
    "DROP VIEW users", "CREATE TABLE t AS SELECT 1", "SET spark.sql.ansi.enabled = false", "INSERT INTO users SELECT 1, 'x', 2",
    "WITH x AS (SELECT 1) INSERT INTO users SELECT 1, 'x', 2", "SELECT 1; DROP VIEW users", "SELECT 1) AS a; DROP VIEW users --",
    "SELECT reflect('java.lang.System', 'nanoTime')", "SELECT java_method('java.lang.System', 'nanoTime')",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM users", "SELECT `reflect`('java.lang.System', 'nanoTime')",
    "SELECT reflect/**/('java.lang.System', 'nanoTime')", "SELECT (SELECT max(java_method('java.lang.System', 'nanoTime'))) FROM users",
    "SELECT count(*) FROM text.`/etc/hostname`", "SELECT 1 WHERE EXISTS (SELECT try_reflect('java.lang.System', 'nanoTime'))",
])
def test_nothing_but_queries_runs(spark, users, sql):
    (outcome, rows), (after, _) = run(spark, users, sql, "SELECT * FROM users")
    assert not outcome.ok and rows == [] and after.ok


def test_timeout(spark, users):
    slow, fast = run(
        spark, users,
        "SELECT count(*) FROM range(1, 4000000000) AS a WHERE sqrt(a.id) * ln(a.id) = 1", "SELECT id FROM users", timeout=4,
    )
    assert not slow[0].ok and "timed out" in slow[0].error
    told = spark.createDataFrame([(slow[0].error,)], "error string").select(error_class(F.col("error"))).first()[0]
    assert told == "TIMEOUT"
    assert fast[0].ok and len(fast[1]) == 3


SLOW = "SELECT count(*) FROM range(1, 4000000000) AS a WHERE sqrt(a.id) * ln(a.id) = 1"


def test_a_slow_statement_costs_only_itself(spark, users, monkeypatch):
    tried = attempts_of(monkeypatch)
    (slow, _), *quick = run(spark, users, SLOW, *[f"SELECT id * {n} FROM users" for n in range(10)], timeout=3, in_flight=3)
    assert not slow.ok and "timed out after 3s" in slow.error
    assert all(outcome.ok and len(rows) == 3 for outcome, rows in quick)
    assert len(tried) == len(set(tried)) == 11


def test_time_counts_from_the_first_task():
    class Context:
        cancelled = []

        def cancelJobsWithTag(self, tag):
            self.cancelled.append((tag, time.monotonic()))

    begun = {}
    limit = execution.Limit(Context(), 0.3, every=0.02)
    limit._began = lambda tag: tag in begun
    with limit, limit.on("one"), limit.on("two"):
        time.sleep(0.6)
        assert not limit.late
        begun["one"] = time.monotonic()
        time.sleep(0.6)
    assert limit.late == {"one"} and {tag for tag, _ in Context.cancelled} == {"one"} and len(Context.cancelled) > 1
    assert Context.cancelled[0][1] - begun["one"] > 0.3


def test_equal_statements_run_once_and_outcomes_join_up(spark, users, monkeypatch):
    monkeypatch.setattr(execution, "WRITTEN_AT_ONCE", 2)
    statements = [f"SELECT id FROM users WHERE id > {n % 5}" for n in range(20)]
    frame = spark.createDataFrame([("db", sql) for sql in statements] + [("other", "SELECT 1")], "db_id string, sql string")
    executions, rows = execute_statements(frame, {"db": users}, in_flight=2)
    assert executions.count() == 6 and rows.count() == 3 + 2 + 1
    assert [row.error for row in executions.filter("NOT ok").collect()] == ["no such database: other"]


def test_sessions_keep_databases_apart(spark, tmp_path):
    sessions = {}
    for name in ("one", "two"):
        spark.createDataFrame([(name,)], "v string").write.parquet(f"{tmp_path}/{name}/t.parquet")
        sessions[name] = register_database(new_database_session(spark), f"{tmp_path}/{name}", ["t"])
    frame = spark.createDataFrame([(name, "SELECT v FROM t") for name in sessions], "db_id string, sql string")
    _, rows = execute_statements(frame, sessions)
    assert sorted(row.vals[0] for row in rows.collect()) == ["one", "two"]


def test_from_replies_to_verdicts(spark, users):
    questions = spark.createDataFrame(
        [(1, "db", "Who?", "SELECT name, age FROM users"), (2, "db", "How many?", "SELECT count(*) FROM users"), (3, "db", "Broken?", "SELECT x FROM users")],
        "question_id long, db_id string, question string, gold_sql string",
    )
    responses = spark.createDataFrame([
        (1, ["```sql\nSELECT age, upper(name) FROM users\n```", "SELECT name FROM users;", "no idea", "SELECT name, age FROM users", "SQL: SELECT name FROM users"]),
        (2, ["SELECT 3", "SQL: SELECT count(name) FROM users", "SELECT count(age) FROM users"]),
        (3, ["SELECT x FROM users"]),
    ], "question_id long, candidates array<string>")
    tables = execute_candidates(questions, responses, {"db": users})
    graded = {(row.question_id, row.candidate_idx): row for row in grade(*tables).collect()}
    assert [key for key, row in sorted(graded.items()) if row.is_correct] == [(1, 1), (1, 4), (2, 1), (2, 2)]
    assert graded[1, 3].error_message == "Empty SQL query" and not graded[3, 1].gold_ok
    for strategy, correct in (("first_correct", 2), ("self_consistency", 1)):
        summary, _ = run_evaluation(tables[0].withColumn("split", F.lit("dev")), *tables[1:], strategy=strategy, model="m")
        row = summary.first()
        assert (row.total, row.correct, row.strategy, row.model) == (3, correct, strategy, "m")
