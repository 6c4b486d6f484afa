"""S*, K*, X4, C1: tables written to the scratch folder and read back, databases, executions."""

from pyspark.sql import functions as F

from demo import views as V
from demo.curation import FIRST, COPIES, first_correct_verdicts, training_set
from demo.expressions import PROMPT
from demo.registry import query
from sqlcurate.operators.reports import last_state, run_summary
from sqlcurate.plans.execution import exec_id, execute_statements
from sqlcurate.plans.grading import execute_candidates, grade
from sqlcurate.schemas import HISTORY, RETRAIN_HISTORY
from sqlcurate.sources import readers, writers
from sqlcurate.sources.storage import scratch_path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@query("s1_load_questions", """
    SELECT sha256(concat_ws(chr(1), split, db_id, question, gold_sql, 1)) AS question_id, split, db_id, question, gold_sql FROM q""")
def s1(spark, sf):
    return readers.load_questions(spark, write_questions(spark, V.questions(spark, sf)))


def write_questions(spark, questions):
    folder = scratch_path(spark, "questions")
    for split, name in readers.SPLIT_FILES.items():
        own = questions.filter(F.col("split") == split)
        own.select("question", F.col("gold_sql").alias("query"), "db_id", F.col("question_id").alias("no")).write.json(f"{folder}/{name}")
    return folder


@query("s1_equal_questions", """
    , e AS (SELECT split, db_id, 'Which orders did they place?' AS question, 'SELECT o_orderstatus FROM orders' AS gold_sql FROM q)
    SELECT sha256(concat_ws(chr(1), split, db_id, question, gold_sql, row_number() OVER (PARTITION BY split, db_id))) AS question_id,
           split, db_id, question, gold_sql FROM e""")
def s1_equal(spark, sf):
    same = V.questions(spark, sf).withColumns({"question": F.lit("Which orders did they place?"), "gold_sql": F.lit("SELECT o_orderstatus FROM orders")})
    return readers.load_questions(spark, write_questions(spark, same))


@query("s1_given_id", "SELECT question_id::VARCHAR AS question_id, split, db_id, question, gold_sql FROM q")
def s1_given(spark, sf):
    return readers.load_questions(spark, write_questions(spark, V.questions(spark, sf)), id_column="no")


@query("s2_load_catalog", """
    , t AS (SELECT DISTINCT db_id, slot, table_name FROM cat),
    n AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY slot) - 1 AS table_idx FROM t)
    SELECT db_id, table_idx, table_name, row_number() OVER (PARTITION BY db_id, slot ORDER BY line) - 1 AS column_idx, column_name
    FROM cat JOIN n USING (db_id, slot, table_name)""")
def s2(spark, sf):
    columns = V.order_catalog(spark, sf)
    tables = columns.groupBy("db_id", "slot", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("line", "column_name"))).alias("cols")
    )
    per_db = tables.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("slot", "table_name", "cols"))).alias("t"))
    entries = F.flatten(F.transform(
        "t", lambda t, i: F.transform(t["cols"], lambda c: F.array(i.cast("string"), c["column_name"]))
    ))
    path = scratch_path(spark, "catalog")
    per_db.select(
        "db_id",
        F.transform("t", lambda t: t["table_name"]).alias("table_names_original"),
        F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), entries).alias("column_names_original"),
    ).write.json(path)
    return readers.load_catalog(spark, path)


@query("s3_load_gold_tsv", "SELECT gold_sql || ' AND o_clerk = \"x\\y\"' AS gold_sql, db_id FROM q")
def s3(spark, sf):
    path = scratch_path(spark, "gold")
    quoted = V.text(F.col("gold_sql"), ' AND o_clerk = "x\\y"')
    V.questions(spark, sf).select(F.concat_ws("\t", quoted, "db_id").alias("value")).write.text(path)
    return readers.load_gold_tsv(spark, path)


@query("s4_register_database", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def s4(spark, sf):
    session = readers.register_database(readers.new_database_session(spark), sf, TABLES)
    return session.sql(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))


def error_entry(question, category):
    """An entry of an errors file; only the fields that it has."""
    return F.struct(
        question.alias("question"), V.text("nation_", F.col("user_id") % 25).alias("db_id"),
        F.when(F.col("event_id") % 2 == 0, V.text("SELECT ", F.col("event_id"))).alias("gold_sql"),
        F.when(F.col("event_id") % 2 == 1, V.text("SELECT ", F.col("event_id"))).alias("query"),
        F.lit(False).alias("is_correct"),
    )


def write_error_documents(spark, sf, path):
    """One document per 256 events: every third a plain list, the others a map by category.

    Events are dealt by document before their entries are made, in one shuffle, so all tasks make, write and read them.
    """
    file = F.floor(F.col("event_id") / 256).alias("file")
    dealt = V.read(spark, sf, "events").select(file, "event_id", "user_id", "event_type").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "file"
    )
    events = dealt.select(
        "file", "event_type",
        error_entry(V.text("event ", F.col("event_id")), F.col("event_type")).alias("entry"),
    )
    by_type = events.groupBy("file", "event_type").agg(F.collect_list("entry").alias("entries"))
    by_file = by_type.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "entries"))).alias("errors"))
    listed = F.to_json(F.flatten(F.map_values("errors")))
    mapped = F.to_json(F.struct("errors"))
    by_file.select(F.when(F.col("file") % 3 == 0, listed).otherwise(mapped).alias("value")).write.text(path)


ERRORS = """
    SELECT 'event ' || event_id AS question, 'nation_' || user_id % 25 AS db_id, 'SELECT ' || event_id AS gold,
           CASE WHEN (event_id // 256) % 3 <> 0 THEN event_type END AS error_category FROM events"""


@query("s5_load_errors", ERRORS)
def s5(spark, sf):
    path = scratch_path(spark, "errors")
    write_error_documents(spark, sf, path)
    errors = readers.load_errors(spark, path, layout="documents")
    return errors.select("question", "db_id", F.coalesce("gold_sql", "query").alias("gold"), "error_category")


@query("x4_categories_to_rows", """
    SELECT event_type AS error_category, count(*) AS n_errors FROM events WHERE (event_id // 256) % 3 <> 0 GROUP BY 1""")
def x4(spark, sf):
    path = scratch_path(spark, "errors")
    write_error_documents(spark, sf, path)
    errors = readers.load_errors(spark, path, layout="documents").filter("error_category IS NOT NULL")
    return errors.groupBy("error_category").agg(F.count("*").alias("n_errors"))


@query("s6_load_reports", """
    SELECT 'model_' || c_nationkey AS model, CASE WHEN c_nationkey % 2 = 0 THEN 8 END AS k_candidates, NULL::DOUBLE AS temperature,
           count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS correct, count(*) FILTER (WHERE c_acctbal > 0) / count(*) AS accuracy
    FROM customer GROUP BY c_nationkey""")
def s6(spark, sf):
    nation, good = F.col("c_nationkey"), F.count_if(F.col("c_acctbal") > 0)
    path = scratch_path(spark, "reports")
    V.read(spark, sf, "customer").groupBy(nation).agg(
        F.count("*").alias("total"), good.alias("correct"), (good / F.count("*")).alias("accuracy")
    ).select(
        V.text("model_", nation).alias("model"), F.when(nation % 2 == 0, V.K).alias("k_candidates"), "total", "correct", "accuracy"
    ).write.json(path)
    return readers.load_reports(spark, path).select("model", "k_candidates", "temperature", "total", "correct", "accuracy")


@query("k1_write_sft", COPIES + f"""
    SELECT {PROMPT} AS instruction, '' AS input, output, count(*) AS n_rows
    FROM copies JOIN lq USING (question_id) LEFT JOIN schemas USING (db_id) GROUP BY ALL""")
def k1(spark, sf):
    path = scratch_path(spark, "sft")
    writers.write_sft(training_set(spark, sf), path)
    rows = spark.read.json(path, schema="instruction string, input string, output string")
    return rows.groupBy("instruction", "input", "output").agg(F.count("*").alias("n_rows"))


@query("k2_write_report", FIRST + """
    , run AS (SELECT count(*) AS total, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM out)
    SELECT question_id, is_correct, candidate_idx, (SELECT total FROM run) AS total, (SELECT accuracy FROM run) AS accuracy FROM out""")
def k2(spark, sf):
    path = scratch_path(spark, "report")
    verdicts = first_correct_verdicts(spark, sf).withColumn("run_id", F.lit("r1"))
    writers.write_report(run_summary(verdicts, run_id="r1"), verdicts, path)
    runs = spark.read.json(f"{path}/runs", schema="run_id string, total long, accuracy double")
    return spark.read.schema(verdicts.schema).parquet(f"{path}/verdicts").join(runs, "run_id").select(
        "question_id", "is_correct", "candidate_idx", "total", "accuracy"
    )


@query("k3_write_errors", FIRST + "SELECT question, db_id, gold_sql, predicted_sql, error FROM out WHERE NOT is_correct")
def k3(spark, sf):
    path = scratch_path(spark, "errors")
    writers.write_errors(first_correct_verdicts(spark, sf), path)
    return readers.load_errors(spark, path, layout="lines").select("question", "db_id", "gold_sql", "predicted_sql", "error")


def _history(spark, sf):
    """History written in two appends."""
    path = scratch_path(spark, "history")
    rows = V.history(spark, sf)
    writers.append_history(rows.filter("iteration < 1998"), path)
    writers.append_history(rows.filter("iteration >= 1998"), path)
    return readers.load_history(spark, path)


@query("k4_append_history", f"SELECT {', '.join(HISTORY.fieldNames())} FROM hist")
def k4(spark, sf):
    return _history(spark, sf)


@query("k5_last_state", f"SELECT {', '.join(HISTORY.fieldNames())} FROM hist ORDER BY iteration DESC LIMIT 1")
def k5(spark, sf):
    return last_state(_history(spark, sf))


@query("k4_append_again", f"SELECT {', '.join(HISTORY.fieldNames())} FROM hist")
def k4_again(spark, sf):
    """Every iteration appended twice, first with other figures, as by a run that failed and was retried."""
    path = scratch_path(spark, "history")
    rows = V.history(spark, sf)
    writers.append_history(rows.withColumn("dev_accuracy", F.lit(0.5)), path)
    writers.append_history(rows.filter("iteration < 1998"), path)
    writers.append_history(rows.filter("iteration >= 1998"), path)
    return readers.load_history(spark, path)


@query("k4_append_retrain_history", """
    SELECT iteration, 'model_' || iteration AS model, train_total AS total_errors, train_correct AS star_count,
           total_training_examples AS injection_count, train_accuracy AS star_ratio, ts FROM hist""")
def k4_retrain(spark, sf):
    path = scratch_path(spark, "history")
    rows = V.history(spark, sf).select(
        "iteration", V.text("model_", F.col("iteration")).alias("model"), F.col("train_total").alias("total_errors"),
        F.col("train_correct").alias("star_count"), F.col("total_training_examples").alias("injection_count"),
        F.col("train_accuracy").alias("star_ratio"), "ts",
    )
    writers.append_history(rows, path, RETRAIN_HISTORY)
    return readers.load_history(spark, path, RETRAIN_HISTORY)


# Statements put to the star schema, with the number of rows each returns in DuckDB.
# None marks a statement that has to fail.
STATEMENTS = [
    ("SELECT n_name FROM nation ORDER BY n_name", "SELECT count(*) FROM nation"),
    ("select count(*) from lineitem;", "SELECT 1"),
    ("SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment", "SELECT count(DISTINCT c_mktsegment) FROM customer"),
    ("SELECT * FROM orders AS a JOIN customer AS b ON a.o_custkey = b.c_custkey WHERE o_orderstatus = 'F'",
     "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'"),
    ("SELECT l_orderkey, l_quantity FROM lineitem", "SELECT count(*) FROM lineitem"),
    ("WITH big AS (SELECT * FROM part WHERE p_size > 25) SELECT p_type, max(p_retailprice) FROM big GROUP BY p_type",
     "SELECT count(DISTINCT p_type) FROM part WHERE p_size > 25"),
    ("SELECT s_name FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
     "SELECT count(*) FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)"),
    ("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
     "SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"),
    ("SELECT DISTINCT event_type FROM events", "SELECT count(DISTINCT event_type) FROM events"),
    ("SELECT o_orderpriority, max(o_totalprice) FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 3", "SELECT 3"),
    ("SELECT l_orderkey, l_quantity FROM lineitem ORDER BY l_quantity", "SELECT count(*) FROM lineitem"),
    ("-- all of them\nSELECT p_name FROM part", "SELECT count(*) FROM part"),
    ("SELECT `reflect`('java.lang.System', 'nanoTime') FROM nation", None),
    ("SELECT FROM WHERE", None),
    ("SELECT * FROM no_such_table", None),
    ("SELECT c_fax FROM customer", None),
    ("SELECT CAST(c_name AS INT) FROM customer", None),
    ("DROP TABLE orders", None),
    ("  ", None),
]


def _quoted(sql):
    return "'" + sql.replace("'", "''") + "'"


@query("c1_execute_statements", " UNION ALL ".join(
    f"SELECT sha256(concat_ws(chr(1), 'star', {_quoted(sql)})) AS exec_id, {rows is not None} AS ok, ({rows or 0})::BIGINT AS n_rows"
    for sql, rows in STATEMENTS
))
def c1(spark, sf):
    database = readers.register_database(readers.new_database_session(spark), sf, TABLES)
    statements = spark.createDataFrame([("star", sql) for sql, _ in STATEMENTS], "db_id string, sql string")
    executions, _ = execute_statements(statements, {"star": database})
    return executions.select("exec_id", "ok", F.col("n_kept").alias("n_rows"))


# Questions on the star schema with their gold statement and three replies each.
ASKED = [
    (
        "How many orders are there per status?",
        "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus",
        [
            "```sql\nSELECT count(*), o_orderstatus FROM orders GROUP BY o_orderstatus\n```",
            "SELECT o_orderstatus, count(*) FROM orders WHERE o_orderpriority != '5-LOW' GROUP BY o_orderstatus;",
            "SQL: SELECT o_state, count(*) FROM orders GROUP BY o_state",
        ],
    ),
    (
        "In which market segments are there finished and open orders?",
        "SELECT c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' "
        "INTERSECT SELECT c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'",
        [
            "SELECT c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment "
            "HAVING max(o_orderstatus = 'F') AND max(o_orderstatus = 'O')",
            "SELECT c_mktsegment FROM customer WHERE c_mktsegment != 'BUILDING'",
            "I do not know.",
        ],
    ),
    (
        "How many large returned lines are there per part type?",
        "SELECT p_type, count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY p_type",
        [
            "SELECT p_type, count(l_orderkey) FROM part JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' WHERE l_quantity >= 46 GROUP BY p_type",
            "SELECT p_type, count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND l_quantity > 45 GROUP BY p_type",
            "SELECT p_type, count(*) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type",
        ],
    ),
]
# The same replies for DuckDB, with columns in gold order; None has no answer.
ANSWERS = [
    ["SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", ASKED[0][2][1].removesuffix(";"), None],
    [ASKED[1][2][0].replace("max(", "bool_or("), ASKED[1][2][1], None],
    ASKED[2][2],
]


def _duck_verdict(question, idx, gold, answer):
    if answer is None:
        return f"SELECT {question} AS question_id, {idx} AS candidate_idx, false AS pred_ok, false AS is_correct"
    return f"""SELECT {question} AS question_id, {idx} AS candidate_idx, true AS pred_ok,
        NOT EXISTS (({gold}) EXCEPT ({answer})) AND NOT EXISTS (({answer}) EXCEPT ({gold})) AS is_correct"""


@query("c2_execute_and_grade", " UNION ALL ".join(
    _duck_verdict(q, c, gold, answer)
    for q, ((_, gold, _), answers) in enumerate(zip(ASKED, ANSWERS)) for c, answer in enumerate(answers, start=1)
))
def c2_execute(spark, sf):
    database = readers.register_database(readers.new_database_session(spark), sf, TABLES)
    questions = spark.createDataFrame(
        [(i, "star", question, gold) for i, (question, gold, _) in enumerate(ASKED)],
        "question_id int, db_id string, question string, gold_sql string",
    )
    responses = spark.createDataFrame([(i, replies) for i, (*_, replies) in enumerate(ASKED)], "question_id int, candidates array<string>")
    graded = grade(*execute_candidates(questions, responses, {"star": database}))
    return graded.select("question_id", "candidate_idx", "pred_ok", "is_correct")
