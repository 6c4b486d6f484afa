"""Small numeric and fallback rules."""

from pyspark.sql import Column, DataFrame, functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def difficulty_weight(n_correct: Column, k: int) -> Column:
    """Copies a correct answer is worth: more failures, more copies; none correct counts as k."""
    return F.when(n_correct == 0, F.lit(k)).otherwise(F.greatest(F.lit(1), F.lit(k) - n_correct)).cast("int")


def gold_of(df: DataFrame) -> Column:
    """Gold SQL of an error entry: `gold_sql` if the entry has one (even ''), else `query`, else ''."""
    present = [F.col(name) for name in ("gold_sql", "query") if name in df.columns]
    return F.coalesce(*present, F.lit(""))


def fill_candidates(candidates: Column) -> Column:
    """No list or an empty one becomes one empty reply; an absent reply becomes ''."""
    filled = F.transform(candidates, lambda reply: F.coalesce(reply, F.lit("")))
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, F.array(F.lit(""))).otherwise(filled)


def failed_generation(k: int) -> Column:
    return F.array_repeat(F.lit(""), k)
