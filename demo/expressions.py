"""Projections."""

from pyspark.sql import functions as F

from demo import views as V
from demo.registry import query
from sqlcurate.functions import cells, prompting, scoring, text
from sqlcurate.operators.catalog import render_schemas
from sqlcurate.operators.questions import attach_schema, question_stats
from sqlcurate.functions.text import error_class, error_preview
from demo.catalogs import flat_catalog

# DuckDB forms, written for these tables: their text has ASCII whitespace only.
STRIP = r"trim({0}, E' \t\n\r' || chr(11) || chr(12))"
SQL_OF_DOC = f"""
    CASE WHEN regexp_matches(response, '```sql.*?```', 'is')
              AND {STRIP.format("regexp_extract(response, '```sql(.*?)```', 1, 'is')")} <> ''
         THEN {STRIP.format("regexp_extract(response, '```sql(.*?)```', 1, 'is')")}
         WHEN NOT regexp_matches(response, '```sql.*?```', 'is')
              AND regexp_matches(response, 'SQL:\\s*SELECT', 'is')
         THEN {STRIP.format("regexp_extract(response, 'SQL:\\s*(SELECT.*?)(?:\\n\\n|$)', 1, 'is')")}
         ELSE {STRIP.format("regexp_extract(response, '(SELECT\\s+.+?)(?:;|```|\\n\\n|$)', 1, 'is')")} END"""


@query("p1_extract_sql", f"SELECT doc_id, {SQL_OF_DOC} AS sql FROM doc_reply")
def p1(spark, sf):
    return V.replies(spark, sf).select("doc_id", text.extract_sql(F.col("response")).alias("sql"))


@query("p2_extract_reasoning", f"""
    , cut AS (SELECT doc_id, CASE
        WHEN instr(lower(response), 'sql:') > 1 THEN {STRIP.format("left(response, instr(lower(response), 'sql:') - 1)")}
        WHEN contains(response, '```') THEN {STRIP.format("split_part(response, '```', 1)")}
        ELSE response END AS r FROM doc_reply)
    SELECT doc_id, CASE WHEN lower(r) LIKE 'reasoning:%' THEN {STRIP.format("substr(r, 11)")} ELSE r END AS reasoning
    FROM cut""")
def p2(spark, sf):
    return V.replies(spark, sf).select("doc_id", text.extract_reasoning(F.col("response")).alias("reasoning"))


@query("p3_normalize_sql", rf"""
    SELECT doc_id, {STRIP.format(r"regexp_replace(lower(response), '[\s\x0b]+', ' ', 'g')")} AS normalised FROM doc_reply""")
def p3(spark, sf):
    return V.replies(spark, sf).select("doc_id", text.normalize_sql(F.col("response")).alias("normalised"))


@query("p4_exact_match", rf"""
    , s AS (SELECT doc_id, gold_sql, {SQL_OF_DOC} AS sql FROM doc_reply)
    SELECT doc_id, trim(regexp_replace(lower(sql), '\s+', ' ', 'g'))
                 = trim(regexp_replace(lower(gold_sql), '\s+', ' ', 'g')) AS is_exact
    FROM s""")
def p4(spark, sf):
    sql = text.extract_sql(F.col("response"))
    return V.replies(spark, sf).select("doc_id", text.exact_match(sql, F.col("gold_sql")).alias("is_exact"))


@query("p5_norm_cell", """
    SELECT exec_id, row_no, coalesce(trim(lower(vals[1])), '<NULL>') AS cell_1,
           coalesce(trim(lower(vals[2])), '<NULL>') AS cell_2 FROM rows_""")
def p5(spark, sf):
    vals = F.col("vals")
    return V.exec_rows(spark, sf).select(
        "exec_id", "row_no", cells.norm_cell(vals[0]).alias("cell_1"), cells.norm_cell(vals[1]).alias("cell_2")
    )


@query("p6_row_key", "SELECT exec_id, row_no, array_to_string(row_key, '|') AS row_key FROM keyed")
def p6(spark, sf):
    key = F.array_join(cells.row_key(F.col("vals")), "|")
    return V.exec_rows(spark, sf).select("exec_id", "row_no", key.alias("row_key"))


@query("p7_strict_row", "SELECT exec_id, row_no, strict_row FROM keyed")
def p7(spark, sf):
    return V.exec_rows(spark, sf).select("exec_id", "row_no", cells.strict_row(F.col("vals")).alias("strict_row"))


PROMPT = f"""'{prompting.PROMPT_HEAD}' || coalesce(schema_text, '') || '{prompting.PROMPT_MIDDLE}' || question
    || '{prompting.PROMPT_TAIL}'"""


def _prompts(spark, sf):
    asked = attach_schema(V.line_questions(spark, sf), V.schemas(spark, sf))
    return asked.withColumn("prompt", prompting.format_prompt(F.col("question"), F.col("schema_text")))


@query("p8_format_prompt", f"SELECT question_id, {PROMPT} AS prompt FROM lq LEFT JOIN schemas USING (db_id)")
def p8(spark, sf):
    return _prompts(spark, sf).select("question_id", "prompt")


@query("p9_chat_messages", f"""
    SELECT question_id, 2 AS n_messages, 'system: {prompting.SYSTEM_PROMPT}' AS first, 'user: ' || {PROMPT} AS second
    FROM lq LEFT JOIN schemas USING (db_id)""")
def p9(spark, sf):
    chat = _prompts(spark, sf).withColumn("m", prompting.chat_messages(F.col("prompt")))
    lines = [F.concat_ws(": ", F.col("m")[i]["role"], F.col("m")[i]["content"]) for i in (0, 1)]
    return chat.select("question_id", F.size("m").alias("n_messages"), lines[0].alias("first"), lines[1].alias("second"))


@query("p10_sft_prompt_as_instruction", f"""
    SELECT question_id, {PROMPT} AS instruction, '' AS input, gold_sql AS output
    FROM lq LEFT JOIN schemas USING (db_id)""")
def p10(spark, sf):
    return _prompts(spark, sf).select(
        "question_id", *prompting.sft_prompt_as_instruction(F.col("prompt"), F.col("gold_sql"))
    )


@query("p11_sft_prompt_as_input", f"""
    SELECT question_id, '{prompting.SYSTEM_PROMPT}' AS instruction, {PROMPT} AS input, gold_sql AS output
    FROM lq LEFT JOIN schemas USING (db_id)""")
def p11(spark, sf):
    return _prompts(spark, sf).select(
        "question_id", *prompting.sft_prompt_as_input(F.col("prompt"), F.col("gold_sql"))
    )


@query("p12_error_class", """
    SELECT event_id, CASE WHEN regexp_matches(message, 'timeout|interrupt', 'i') THEN 'TIMEOUT'
                          WHEN regexp_matches(message, 'syntax|near', 'i') THEN 'SYNTAX'
                          WHEN regexp_matches(message, 'no such', 'i') THEN 'SCHEMA' ELSE 'ERROR' END AS error_class,
           CASE WHEN message = '' THEN 'Unknown' ELSE left(message, 100) END AS preview
    FROM err""")
def p12(spark, sf):
    message = F.col("message")
    return V.error_messages(spark, sf).select(
        "event_id", error_class(message).alias("error_class"), error_preview(message).alias("preview")
    )


@query("p13_difficulty_weight", """
    SELECT question_id, n_correct, n_total,
           (CASE WHEN n_correct = 0 THEN 8 ELSE greatest(1, 8 - n_correct) END)::INTEGER AS weight FROM gstat""")
def p13(spark, sf):
    weight = scoring.difficulty_weight(F.col("n_correct"), V.K)
    return question_stats(V.graded_lines(spark, sf)).select("question_id", "n_correct", "n_total", weight.alias("weight"))


@query("p14_gold_of", """
    SELECT o_orderkey AS question_id, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN o_orderpriority
           ELSE coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT ' || o_orderkey END, '') END AS gold FROM orders""")
def p14(spark, sf):
    status = F.col("o_orderstatus")
    entries = V.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        F.when(status == "F", "").when(status == "O", F.col("o_orderpriority")).alias("gold_sql"),
        F.when(F.col("o_orderkey") % 2 == 0, V.text("SELECT ", F.col("o_orderkey"))).alias("query"),
    )
    return entries.select("question_id", scoring.gold_of(entries).alias("gold"))


@query("p15_fill_candidates", """
    , filled AS (SELECT o_orderkey AS question_id, unnest(CASE o_orderkey % 4
            WHEN 0 THEN [''] WHEN 1 THEN [''] WHEN 2 THEN [o_orderpriority, '']
            ELSE ['', '', '', '', '', '', '', ''] END) AS response FROM orders)
    SELECT question_id, response, count(*) AS n FROM filled GROUP BY ALL""")
def p15(spark, sf):
    shape, priority = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    listed = F.when(shape == 1, F.array().cast("array<string>")).when(
        shape == 2, F.array(priority, F.lit(None).cast("string"))
    ).when(shape == 3, scoring.failed_generation(V.K))
    filled = V.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.explode(scoring.fill_candidates(listed)).alias("response")
    )
    return filled.groupBy("question_id", "response").agg(F.count("*").alias("n"))


@query("p16_render_schemas", """
    , ddl AS (SELECT db_id, slot, 'CREATE TABLE ' || table_name || ' (' || string_agg(column_name, ', ' ORDER BY line) || ')' AS line
              FROM cat GROUP BY db_id, slot, table_name)
    SELECT db_id, string_agg(line, chr(10) || chr(10) ORDER BY slot) AS schema_text FROM ddl GROUP BY db_id""")
def p16(spark, sf):
    return render_schemas(flat_catalog(spark, sf))


@query("p17_cell_preview", """
    SELECT p_partkey, left(p_name, 20) AS name_preview, left(p_type || ' ' || p_brand || ' ' || p_partkey, 20) AS label_preview
    FROM part""")
def p17(spark, sf):
    label = V.text(F.col("p_type"), " ", F.col("p_brand"), " ", F.col("p_partkey"))
    return V.read(spark, sf, "part").select(
        "p_partkey", cells.cell_preview(F.col("p_name")).alias("name_preview"), cells.cell_preview(label).alias("label_preview")
    )


@query("p18_ratio", """
    SELECT question_id, CASE WHEN n_ok > 0 THEN n_both / n_ok ELSE 0.0 END::DOUBLE AS share
    FROM (SELECT question_id, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE ok AND is_correct) AS n_both
          FROM g GROUP BY question_id)""")
def p18(spark, sf):
    counts = V.graded_lines(spark, sf).groupBy("question_id").agg(
        F.count_if("ok").alias("n_ok"), F.count_if(F.col("ok") & F.col("is_correct")).alias("n_both")
    )
    return counts.select("question_id", scoring.ratio(F.col("n_both"), F.col("n_ok")).alias("share"))
