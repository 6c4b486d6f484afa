"""Prompts, chat messages and training rows."""

from pyspark.sql import Column, functions as F

# The texts that models were trained with.
SYSTEM_PROMPT = (
    "You are an expert SQL developer. "
    "Given a database schema and a question, write the correct SQLite query."
)
PROMPT_HEAD = "Given the following database schema:\n\n"
PROMPT_MIDDLE = "\n\nQuestion: "
PROMPT_TAIL = "\n\nWrite the SQL query that answers the question.\n\nSQL:"


def format_prompt(question: Column, schema_text: Column) -> Column:
    return F.concat(
        F.lit(PROMPT_HEAD), schema_text, F.lit(PROMPT_MIDDLE), question, F.lit(PROMPT_TAIL)
    )


def chat_messages(prompt: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", prompt))


def sft_prompt_as_instruction(prompt: Column, output: Column) -> list[Column]:
    """Layout of a training iteration: the prompt is the instruction, the input stays empty."""
    return [prompt.alias("instruction"), F.lit("").alias("input"), output.alias("output")]


def sft_prompt_as_input(prompt: Column, output: Column) -> list[Column]:
    """Layout of a retraining on errors: the system prompt is the instruction."""
    return [F.lit(SYSTEM_PROMPT).alias("instruction"), prompt.alias("input"), output.alias("output")]
