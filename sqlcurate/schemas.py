"""Table layouts shared by the readers, the jobs and the tests."""

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

# On disk, before ids and splits are known.
RAW_QUESTIONS = _table(question=S, query=S, db_id=S)
RAW_CATALOG = _table(
    db_id=S,
    table_names_original=T.ArrayType(S),
    column_names_original=T.ArrayType(T.ArrayType(S)),
)
GOLD_TSV = _table(gold_sql=S, db_id=S)

# One row per execution; rows of its result; both keyed by exec_id.
EXECUTIONS = _table(exec_id=S, ok=B, error=S, truncated=B)
EXEC_ROWS = _table(exec_id=S, row_no=L, vals=T.ArrayType(S))

# One entry of an errors file. `query` is what older files call `gold_sql`.
ERROR_ENTRY = _table(
    question_id=S, question=S, db_id=S, gold_sql=S, query=S, predicted_sql=S, error=S, is_correct=B,
    candidate_idx=I, reasoning=S, gold_error=B, vote_count=L, total_candidates=L,
)

REPORTS = _table(
    model=S, lora=S, prompt=S, split=S, k_candidates=I, strategy=S, temperature=D,
    total=L, correct=L, accuracy=D, timestamp=S,
)

HISTORY = _table(
    iteration=I, train_accuracy=D, train_correct=L, train_total=L, dev_accuracy=D,
    sft_examples=L, injected_examples=L, total_training_examples=L, ts=T.TimestampType(),
)

RETRAIN_HISTORY = _table(
    iteration=I, model=S, total_errors=L, star_count=L, injection_count=L, star_ratio=D, ts=T.TimestampType(),
)
