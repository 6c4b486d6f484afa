"""Whole rows as one column, so that an operator's own columns clash with none of theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """`doc`, a struct of all columns, and further columns computed from those of `docs`."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(name) for name, c in more.items()])


def named(column: str) -> Column:
    return F.col(f"`{column}`")
