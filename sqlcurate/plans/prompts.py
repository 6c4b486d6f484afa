"""Prompts for a set of questions."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcurate.functions.prompting import chat_messages, format_prompt
from sqlcurate.operators.catalog import database_values, render_schemas, top_values
from sqlcurate.operators.questions import attach_schema


def sample_values(catalog: DataFrame, sessions: dict[str, SparkSession], per_column: int = 3, per_table: int = 2) -> DataFrame:
    """The values shown in prompts, from a catalog and the databases it describes."""
    return top_values(database_values(catalog, sessions), per_column, per_table)


def prompts_of(questions: DataFrame, catalog: DataFrame, sessions: dict[str, SparkSession]) -> DataFrame:
    """From questions, catalog and databases to prompts, in one job."""
    return build_prompts(questions, catalog, database_values(catalog, sessions))


def build_prompts(questions: DataFrame, catalog: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Adds `prompt` and `messages`; `values` are melted cells of the sampleable columns."""
    schemas = render_schemas(catalog, None if values is None else top_values(values))
    prompt = format_prompt(F.col("question"), F.col("schema_text"))
    return (
        attach_schema(questions, schemas)
        .withColumn("prompt", prompt)
        .withColumn("messages", chat_messages(F.col("prompt")))
    )
