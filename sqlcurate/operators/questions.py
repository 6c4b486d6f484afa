"""Questions joined to what was produced for them, and counts per question."""

from pyspark.sql import DataFrame, functions as F

from sqlcurate.functions.scoring import fill_candidates, ratio
from sqlcurate.functions.text import extract_reasoning, extract_sql, is_blank


def explode_candidates(responses: DataFrame, column: str = "candidates") -> DataFrame:
    """One row per reply, numbered from 1 in the order of generation."""
    others = [name for name in responses.columns if name != column]
    return responses.select(*others, F.posexplode(fill_candidates(F.col(column))).alias("_pos", "response")).select(
        *others, (F.col("_pos") + 1).alias("candidate_idx"), "response"
    )


def parse_candidates(candidates: DataFrame) -> DataFrame:
    """Reasoning and SQL instead of each reply.

    The SQL is a generated column, which Spark computes once: a filter on a projected one would be moved before the
    projection and search every reply a second time.
    """
    return candidates.select(
        *[name for name in candidates.columns if name != "response"],
        extract_reasoning(F.col("response")).alias("reasoning"),
        F.explode(F.array(extract_sql(F.col("response")))).alias("predicted_sql"),
    )


# What an unanswered question has in place of a candidate.
UNANSWERED = {"predicted_sql": "", "reasoning": "", "response": "", "pred_ok": False, "pred_error": "Empty SQL query"}


def attach_candidates(questions: DataFrame, candidates: DataFrame, k: int = 1) -> DataFrame:
    """Candidates with their question. A question without any gets `k` empty ones, numbered from 1.

    Spark takes exploded replies to be as large as the lists they come from, and might collect millions of candidates
    in the driver to broadcast them; the hint has both sides shuffled and sorted.
    """
    joined = questions.join(candidates.withColumn("_answered", F.lit(True)).hint("merge"), "question_id", "left")
    answered = F.col("_answered").isNotNull()
    slots = F.when(answered, F.array(F.col("candidate_idx").cast("int"))).otherwise(F.sequence(F.lit(1), F.lit(k)))
    filled = {
        name: F.when(answered, F.col(name)).otherwise(F.lit(value)) for name, value in UNANSWERED.items() if name in candidates.columns
    }
    return joined.withColumns(filled).withColumn("candidate_idx", F.explode(slots)).drop("_answered")


def attach_schema(questions: DataFrame, schemas: DataFrame, strict: bool = False) -> DataFrame:
    """Schema text of each question's database.

    An unknown database has the schema text '', or fails the job under `strict`. There is no
    broadcast hint: Spark broadcasts the schema side when its measured size is under
    `spark.sql.autoBroadcastJoinThreshold` and otherwise splits databases with very many questions.
    """
    missing = F.raise_error(F.concat(F.lit("unknown database: "), F.col("db_id"))) if strict else F.lit("")
    others = [name for name in questions.columns if name != "schema_text"]
    return (
        questions.select(*others)
        .join(schemas.select("db_id", "schema_text"), "db_id", "left")
        .select(*others, F.coalesce("schema_text", missing.cast("string")).alias("schema_text"))
    )


def of_split(questions: DataFrame, split: str) -> DataFrame:
    return questions.filter(F.col("split") == split)


def non_blank(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~is_blank(F.col("predicted_sql")))


def executed_only(executions: DataFrame) -> DataFrame:
    return executions.filter("ok")


def correct_only(graded: DataFrame) -> DataFrame:
    return graded.filter("is_correct")


def wrong_only(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("NOT is_correct")


def _side(df: DataFrame, key: str, prints: DataFrame, side: str) -> DataFrame:
    """Outcome of the execution `key`; a missing one counts as not ok."""
    outcome = prints.select(
        F.col("exec_id").alias(key),
        F.col("ok").alias(f"{side}_ok"),
        F.col("error").alias(f"{side}_error"),
        F.col("set_print").alias(f"{side}_set_print"),
        F.col("bag_print").alias(f"{side}_bag_print"),
    )
    return df.join(outcome, key, "left").withColumn(f"{side}_ok", F.coalesce(f"{side}_ok", F.lit(False)))


def with_gold(questions: DataFrame, prints: DataFrame) -> DataFrame:
    return _side(questions, "gold_exec_id", prints, "gold")


def with_result(candidates: DataFrame, prints: DataFrame) -> DataFrame:
    """Outcome of each candidate. Blank SQL never counts as run, whatever its execution says."""
    ran = _side(candidates.withColumnRenamed("exec_id", "pred_exec_id"), "pred_exec_id", prints, "pred")
    blank = is_blank(F.col("predicted_sql"))
    return ran.withColumn("pred_ok", F.col("pred_ok") & ~blank).withColumn(
        "pred_error", F.when(blank, "Empty SQL query").otherwise(F.col("pred_error"))
    )


def pair_executions(questions: DataFrame, candidates: DataFrame, prints: DataFrame, k: int = 1) -> DataFrame:
    """Candidate and gold execution side by side. Gold is looked up once per question."""
    return attach_candidates(with_gold(questions, prints), with_result(candidates, prints), k)


def flag_gold_errors(verdicts: DataFrame) -> DataFrame:
    """A question whose gold SQL fails is wrong, but stays in the denominator."""
    failed = ~F.col("gold_ok")
    return (
        verdicts.withColumn("is_correct", F.col("is_correct") & ~failed)
        .withColumn("gold_error", failed)
        .withColumn("error", F.when(failed, "Gold SQL failed to execute").otherwise(F.col("error")))
    )


def question_stats(graded: DataFrame, questions: DataFrame | None = None, k: int = 1) -> DataFrame:
    """Counts per question; with `questions`, those that were never graded count as k failures."""
    stats = graded.groupBy("question_id").agg(F.count_if("is_correct").alias("n_correct"), F.count("*").alias("n_total"))
    if questions is None:
        return stats
    return questions.select("question_id").join(stats, "question_id", "left").select(
        "question_id", F.coalesce("n_correct", F.lit(0)).alias("n_correct"), F.coalesce("n_total", F.lit(k)).alias("n_total")
    )


def pass_at_k(graded: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Questions with at least one correct candidate, of those graded or of all `questions`."""
    return (
        question_stats(graded, questions)
        .agg(F.count("*").alias("total"), F.count_if(F.col("n_correct") > 0).alias("correct"))
        .withColumn("accuracy", ratio(F.col("correct"), F.col("total")))
    )


def candidate_accuracy(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct")).withColumn(
        "accuracy", ratio(F.col("correct"), F.col("total"))
    )


def unsolved(graded: DataFrame, questions: DataFrame | None = None, k: int = 1) -> DataFrame:
    """Questions where every candidate failed, with their number of failures (k if none was graded)."""
    return question_stats(graded, questions, k).filter("n_correct = 0").select(
        "question_id", F.col("n_total").alias("n_failures")
    )


def first_correct(graded: DataFrame) -> DataFrame:
    """Lowest-numbered correct candidate of each solved question."""
    first = F.min(F.struct("candidate_idx", "predicted_sql", *[
        name for name in ("reasoning",) if name in graded.columns
    ])).alias("first")
    return correct_only(graded).groupBy("question_id").agg(first).select("question_id", "first.*")


def restore_order(df: DataFrame) -> DataFrame:
    return df.orderBy("question_id", "candidate_idx")


def text_keyed(questions: DataFrame) -> DataFrame:
    """Questions merged by their text, as older reports did; the entry with the highest id wins."""
    rest = [name for name in questions.columns if name not in ("question", "question_id")]
    return (
        questions.groupBy("question")
        .agg(F.max(F.struct("question_id", *rest)).alias("last"))
        .select("last.question_id", "question", *[f"last.{name}" for name in rest])
    )


def not_in(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Rows whose `key` is NOT IN the one column of `others`, as SQL has it, for `others` of any size.

    With a null among `others` no row qualifies; without any others all rows do, also those with a null key; else
    null keys do not. The literal form makes Spark broadcast the subquery whatever its size if either side may be
    null. Here nulls are counted apart, and what is left is an anti join on distinct keys, which is shuffled.
    """
    other = F.col(f"`{others.columns[0]}`")
    listed = others.select(other.alias("_other"))
    n_others = listed.agg(F.count("*")).scalar()
    n_nulls = listed.agg(F.count_if(F.col("_other").isNull())).scalar()
    left = rows.join(listed.filter("_other IS NOT NULL").distinct(), F.col(f"`{key}`") == F.col("_other"), "left_anti")
    return left.filter((n_nulls == 0) & (F.col(f"`{key}`").isNotNull() | (n_others == 0)))
