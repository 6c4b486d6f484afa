"""Text-to-SQL data derived from the star-schema tables, in Spark and in DuckDB.

Two settings, both over whole tables:

* customers ask, orders answer: a customer is a question with eight replies; the result of a reply
  is the customer's orders in one of eight variants (same rows in other case and column order,
  rows doubled, rows missing, failed, blank, ...).
* graded lines: an order is a question and a line item a graded candidate. Line numbers repeat
  inside an order, as they do when a draw is retried.

Everything here is a projection or an explode of one table: no window, and no shuffle but that of `asking`.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlcurate.operators.questions import explode_candidates, parse_candidates
from sqlcurate.operators.results import fingerprint_results
from sqlcurate.sources.storage import stored

K = 8


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def text(*parts) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])


# --- customers ask, orders answer -------------------------------------------------------------

def questions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        key.alias("question_id"),
        F.when(key % 5 == 0, "dev").otherwise("train").alias("split"),
        text("nation_", F.col("c_nationkey")).alias("db_id"),
        text("Which orders did ", F.col("c_name"), " place?").alias("question"),
        text("SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_custkey = ", key).alias("gold_sql"),
        (key * 16).alias("gold_exec_id"),
    )


def asking(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the customers, dealt to all tasks: few bytes, read by one task, of which many rows are made."""
    return read(spark, sf, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def variant(key: Column, slot: Column) -> Column:
    """Slot 0 is the gold result; it fails for one customer in forty."""
    gold = F.when(key % 40 == 7, 2).otherwise(1)
    return F.when(slot == 0, gold).otherwise((key + F.floor(slot * slot / 3)) % 8).cast("int")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")

    def reply(slot: Column) -> Column:
        kind = variant(key, slot)
        sql = text("SELECT o_orderstatus FROM orders WHERE o_custkey = ", key, " AND ", kind, " = ", kind)
        shape = (key + slot) % 5
        return (
            F.when(kind == 6, "I do not know.")
            .when(shape == 0, text("Reading the schema.\n```sql\n", sql, "\n```"))
            .when(shape == 1, text("Reasoning: look up the customer.\nSQL: ", sql, "\n\nDone."))
            .when(shape == 2, text(sql, ";"))
            .when(shape == 3, text("```SQL\n", sql, "\n```"))
            .otherwise(text("Answer: ", sql, "\n\nThat is all."))
        )

    return asking(spark, sf).select(
        key.alias("question_id"), F.transform(F.sequence(F.lit(1), F.lit(K)), reply).alias("candidates")
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_candidates(explode_candidates(responses(spark, sf)))
    return parsed.withColumn("exec_id", F.col("question_id") * 16 + F.col("candidate_idx"))


def executions(spark: SparkSession, sf: str) -> DataFrame:
    slots = asking(spark, sf).select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(K))).alias("slot"))
    kind = variant(F.col("c_custkey"), F.col("slot"))
    return slots.select(
        (F.col("c_custkey") * 16 + F.col("slot")).alias("exec_id"),
        (~kind.isin(2, 6)).alias("ok"),
        F.when(kind == 2, "no such column: o_state").when(kind == 6, "Empty SQL query").alias("error"),
    )


def exec_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Row numbers have gaps: the order key is the position."""
    slots = (
        read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(K))))
        .withColumn("kind", variant(F.col("o_custkey"), F.col("slot")))
        .filter(F.col("kind").isin(0, 1, 4, 7) | ((F.col("kind") == 3) & (F.col("o_orderstatus") == "F")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 4, 1).otherwise(0))))
    )
    hidden = F.nullif("o_orderstatus", F.when(F.col("kind") == 7, "O").otherwise("P"))
    priority = F.col("o_orderpriority")
    return slots.select(
        (F.col("o_custkey") * 16 + F.col("slot")).alias("exec_id"),
        (F.col("o_orderkey") * 2 + F.col("copy")).alias("row_no"),
        F.when(F.col("kind") == 0, F.array(text(" ", hidden, "  "), F.lower(priority)))
        .otherwise(F.array(priority, hidden)).alias("vals"),
    )


def prints(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, as every job looks them up for candidates and for gold."""
    return stored(fingerprint_results(exec_rows(spark, sf), executions(spark, sf)), "prints")


# --- graded lines -----------------------------------------------------------------------------

def line_questions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        key.alias("question_id"),
        text("nation_", F.col("o_custkey") % 27).alias("db_id"),
        text("Which parts are in order ", key, "?").alias("question"),
        text("SELECT l_partkey FROM lineitem WHERE l_orderkey = ", key).alias("gold_sql"),
        (key % 3).cast("string").alias("gold_answer"),
    )


def graded_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_linenumber").alias("candidate_idx"),
        text("SELECT ", F.col("l_partkey"), ", ", F.col("l_suppkey")).alias("predicted_sql"),
        (F.col("l_returnflag") == "R").alias("is_correct"),
        (F.col("l_linestatus") == "F").alias("ok"),
        (F.col("l_suppkey") % 3).cast("string").alias("answer"),
    )


def schemas(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select(
        text("nation_", F.col("n_nationkey")).alias("db_id"),
        text("CREATE TABLE ", F.lower("n_name"), " (key, name)").alias("schema_text"),
    )


# --- other tables -----------------------------------------------------------------------------

def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as model replies in six shapes."""
    key, body = F.col("doc_id"), F.col("text")
    sql = text("SELECT  Text FROM\n\tdocuments WHERE doc_id = ", key, " AND lang = '", F.col("lang"), "'")
    shape = key % 6
    return read(spark, sf, "documents").select("doc_id", "text", "lang").select(
        "doc_id",
        F.when(shape == 0, text(body, "\n```sql\n", sql, "\n```\n", body))
        .when(shape == 1, text(body, "```SQL  ", sql, "\n ```"))
        .when(shape == 2, text("Reasoning: ", body, "\nSQL: ", sql, "\n\n", body))
        .when(shape == 3, text(body, " ", sql, "; ", body))
        .when(shape == 4, text(body, "```sql ```", sql))
        .otherwise(body).alias("response"),
        sql.alias("gold_sql"),
    )


def error_messages(spark: SparkSession, sf: str) -> DataFrame:
    key, props = F.col("event_id"), F.col("props")
    return read(spark, sf, "events").select(
        "event_id",
        F.when(key % 6 == 0, text("no such table: ", F.col("event_type")))
        .when(key % 6 == 1, text('near "', F.col("event_type"), '": syntax error'))
        .when(key % 6 == 2, text("Query timeout after ", F.col("user_id"), "s"))
        .when(key % 6 == 3, text("Interrupted at ", props))
        .when(key % 6 == 4, text("mismatch in ", F.repeat(props, 20)))
        .otherwise("").alias("message"),
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Years of orders as iterations: share of finished orders on train, of urgent ones on dev."""
    total = F.count("*")
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("iteration")).agg(
        (F.count_if(F.col("o_orderstatus") == "F") / total).alias("train_accuracy"),
        F.count_if(F.col("o_orderstatus") == "F").alias("train_correct"),
        total.alias("train_total"),
        (F.count_if(F.col("o_orderpriority") == "1-URGENT") / total).alias("dev_accuracy"),
        F.count_if(F.col("o_orderstatus") == "O").alias("sft_examples"),
        F.count_if(F.col("o_orderstatus") == "P").alias("injected_examples"),
        F.count_if(F.col("o_orderstatus") != "F").alias("total_training_examples"),
        F.max("o_orderdate").alias("ts"),
    )


def order_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A database per 16 orders, a table per order, a column per line number."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return lines.select(
        text("db_", F.floor(F.col("l_orderkey") / 16)).alias("db_id"),
        (F.col("l_orderkey") % 16).cast("int").alias("slot"),
        text("order_", F.col("l_orderkey")).alias("table_name"),
        F.col("l_linenumber").alias("line"),
        text("line_", F.col("l_linenumber")).alias("column_name"),
    )


# Columns of the star-schema tables, in the order of the files.
STAR_CATALOG = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


# --- the same views in DuckDB -----------------------------------------------------------------

VARIANT = "CASE WHEN slot = 0 THEN CASE WHEN {key} % 40 = 7 THEN 2 ELSE 1 END ELSE ({key} + slot * slot // 3) % 8 END"

DUCK_VIEWS = {
    "q": """
        SELECT c_custkey AS question_id, CASE WHEN c_custkey % 5 = 0 THEN 'dev' ELSE 'train' END AS split,
               'nation_' || c_nationkey AS db_id, 'Which orders did ' || c_name || ' place?' AS question,
               'SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_custkey = ' || c_custkey AS gold_sql,
               c_custkey * 16 AS gold_exec_id
        FROM customer""",
    "slots": f"""
        SELECT *, {VARIANT.format(key="c_custkey")} AS kind
        FROM (SELECT c_custkey, unnest(range(0, 9)) AS slot FROM customer)""",
    "exec": """
        SELECT c_custkey * 16 + slot AS exec_id, c_custkey AS question_id, slot, kind NOT IN (2, 6) AS ok,
               CASE kind WHEN 2 THEN 'no such column: o_state' WHEN 6 THEN 'Empty SQL query' END AS error
        FROM slots""",
    "raw": """
        SELECT c_custkey AS question_id, slot AS candidate_idx, (c_custkey + slot) % 5 AS shape, kind,
               'SELECT o_orderstatus FROM orders WHERE o_custkey = ' || c_custkey || ' AND ' || kind || ' = ' || kind AS s
        FROM slots WHERE slot > 0""",
    "reply": r"""
        SELECT question_id, candidate_idx, CASE
            WHEN kind = 6 THEN 'I do not know.'
            WHEN shape = 0 THEN E'Reading the schema.\n```sql\n' || s || E'\n```'
            WHEN shape = 1 THEN E'Reasoning: look up the customer.\nSQL: ' || s || E'\n\nDone.'
            WHEN shape = 2 THEN s || ';'
            WHEN shape = 3 THEN E'```SQL\n' || s || E'\n```'
            ELSE 'Answer: ' || s || E'\n\nThat is all.' END AS response
        FROM raw""",
    "cand": """
        SELECT question_id, candidate_idx, CASE WHEN kind = 6 THEN '' ELSE s END AS predicted_sql,
               CASE WHEN kind = 6 THEN 'I do not know.' WHEN shape = 0 THEN 'Reading the schema.'
                    WHEN shape = 1 THEN 'look up the customer.' WHEN shape = 2 THEN s || ';'
                    WHEN shape = 3 THEN '' ELSE 'Answer: ' || s || chr(10) || chr(10) || 'That is all.' END AS reasoning,
               question_id * 16 + candidate_idx AS exec_id
        FROM raw""",
    "rows_": f"""
        SELECT o_custkey * 16 + slot AS exec_id, o_orderkey * 2 + copy AS row_no,
               CASE WHEN kind = 0 THEN [' ' || shown || '  ', lower(o_orderpriority)] ELSE [o_orderpriority, shown] END AS vals
        FROM (SELECT *, nullif(o_orderstatus, CASE WHEN kind = 7 THEN 'O' ELSE 'P' END) AS shown,
                     unnest(CASE WHEN kind = 4 THEN [0, 1] ELSE [0] END) AS copy
              FROM (SELECT *, {VARIANT.format(key="o_custkey")} AS kind
                    FROM (SELECT *, unnest(range(0, 9)) AS slot FROM orders))
              WHERE kind IN (0, 1, 4, 7) OR (kind = 3 AND o_orderstatus = 'F'))""",
    "keyed": """
        SELECT exec_id, row_no, vals, list_sort([coalesce(trim(lower(c)), '<NULL>') FOR c IN vals]) AS row_key,
               to_json([coalesce(c, 'None') FOR c IN vals])::VARCHAR AS strict_row
        FROM rows_""",
    "sets": """
        SELECT exec_id, ok, error, question_id, slot,
               coalesce(n_rows, 0) AS n_rows, coalesce(n_keys, 0) AS n_keys,
               coalesce(row_set, []) AS row_set, coalesce(row_bag, []) AS row_bag
        FROM exec LEFT JOIN (
            SELECT exec_id, count(*) AS n_rows, count(DISTINCT row_key) AS n_keys,
                   list_sort(list(DISTINCT row_key)) AS row_set, list_sort(list(strict_row)) AS row_bag
            FROM keyed GROUP BY exec_id) USING (exec_id)""",
    "verdict": """
        SELECT q.*, cand.candidate_idx, cand.predicted_sql, cand.reasoning, p.ok AS pred_ok, g.ok AS gold_ok,
               p.error AS pred_error, p.ok AND g.ok AND p.row_set = g.row_set AS is_correct,
               p.row_set AS pred_set, p.row_bag AS pred_bag, g.row_set AS gold_set, g.row_bag AS gold_bag
        FROM q JOIN cand USING (question_id)
        JOIN sets p ON p.exec_id = cand.exec_id JOIN sets g ON g.exec_id = q.gold_exec_id""",
    "lq": """
        SELECT o_orderkey AS question_id, 'nation_' || o_custkey % 27 AS db_id,
               'Which parts are in order ' || o_orderkey || '?' AS question,
               'SELECT l_partkey FROM lineitem WHERE l_orderkey = ' || o_orderkey AS gold_sql,
               (o_orderkey % 3)::VARCHAR AS gold_answer
        FROM orders""",
    "g": """
        SELECT l_orderkey AS question_id, l_linenumber AS candidate_idx,
               'SELECT ' || l_partkey || ', ' || l_suppkey AS predicted_sql, l_returnflag = 'R' AS is_correct,
               l_linestatus = 'F' AS ok, (l_suppkey % 3)::VARCHAR AS answer
        FROM lineitem""",
    "gstat": """
        SELECT question_id, count(*) FILTER (WHERE is_correct) AS n_correct, count(*) AS n_total
        FROM g GROUP BY question_id""",
    "schemas": """
        SELECT 'nation_' || n_nationkey AS db_id, 'CREATE TABLE ' || lower(n_name) || ' (key, name)' AS schema_text
        FROM nation""",
    "doc": r"""
        SELECT doc_id, text, E'SELECT  Text FROM\n\tdocuments WHERE doc_id = ' || doc_id || ' AND lang = ''' || lang || '''' AS gold_sql
        FROM documents""",
    "doc_reply": r"""
        SELECT doc_id, gold_sql, CASE doc_id % 6
            WHEN 0 THEN text || E'\n```sql\n' || gold_sql || E'\n```\n' || text
            WHEN 1 THEN text || '```SQL  ' || gold_sql || E'\n ```'
            WHEN 2 THEN 'Reasoning: ' || text || E'\nSQL: ' || gold_sql || E'\n\n' || text
            WHEN 3 THEN text || ' ' || gold_sql || '; ' || text
            WHEN 4 THEN text || '```sql ```' || gold_sql
            ELSE text END AS response
        FROM doc""",
    "err": r"""
        SELECT event_id, CASE event_id % 6
            WHEN 0 THEN 'no such table: ' || event_type
            WHEN 1 THEN 'near "' || event_type || '": syntax error'
            WHEN 2 THEN 'Query timeout after ' || user_id || 's'
            WHEN 3 THEN 'Interrupted at ' || props
            WHEN 4 THEN 'mismatch in ' || repeat(props, 20)
            ELSE '' END AS message
        FROM events""",
    "hist": """
        SELECT year(o_orderdate)::INTEGER AS iteration,
               count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS train_accuracy,
               count(*) FILTER (WHERE o_orderstatus = 'F') AS train_correct, count(*) AS train_total,
               count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) AS dev_accuracy,
               count(*) FILTER (WHERE o_orderstatus = 'O') AS sft_examples,
               count(*) FILTER (WHERE o_orderstatus = 'P') AS injected_examples,
               count(*) FILTER (WHERE o_orderstatus <> 'F') AS total_training_examples,
               max(o_orderdate) AS ts
        FROM orders GROUP BY 1""",
    "cat": """
        SELECT DISTINCT 'db_' || l_orderkey // 16 AS db_id, (l_orderkey % 16)::INTEGER AS slot,
               'order_' || l_orderkey AS table_name, l_linenumber AS line, 'line_' || l_linenumber AS column_name
        FROM lineitem""",
}
