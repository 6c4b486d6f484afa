"""Rows whose key is in a table, or is not, with all rows kept out of the join that a bitmap of fixed size can spare it.

Whole texts are in these rows, and a shuffled join would move them all for the few that have a partner. The bitmap is
broadcast as words of 64 bits, WORDS rows at most. What it lets through is joined exactly; with more keys than bits
that is all of the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from sqlcurate.sources.storage import stored

#: 64-bit words of the bitmap, which bounds what is broadcast.
WORDS = 1 << 18


def flagged(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `_maybe`, which is false only where the keys of a row are not those of any row of `table`.

    `table` has the key columns in the same order, whatever their names. `_at`, `_word` and `_bits` are taken names.
    """

    def place(columns: list[str]) -> Column:
        return F.xxhash64(*columns).bitwiseAND(64 * WORDS - 1)

    marks = table.select(place(table.columns).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word"))
    bitmap = stored(marks.agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63 AS int)))").alias("_bits")), "bitmap")
    found = rows.withColumn("_at", place(keys)).join(F.broadcast(bitmap), F.shiftright("_at", 6) == F.col("_word"), "left")
    hit = F.coalesce(F.getbit("_bits", F.col("_at").bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return found.withColumn("_maybe", hit).drop("_at", "_word", "_bits")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, of which nulls are equal, are not among those of `gone`, a stored table with these columns."""
    known = flagged(rows, gone.select(*keys), keys)
    asked = known.filter("_maybe").drop("_maybe")
    return known.filter("NOT _maybe").drop("_maybe").unionByName(_joined(asked, gone, keys, "left_anti"))


def only(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, of which nulls are equal, are among those of `asked`, a stored table with these columns."""
    return _joined(flagged(rows, asked.select(*keys), keys).filter("_maybe").drop("_maybe"), asked, keys, "left_semi")


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    listed = table.select(*[F.col(k).alias(f"listed_{k}") for k in keys])
    return rows.join(listed, reduce(and_, [F.col(k).eqNullSafe(F.col(f"listed_{k}")) for k in keys]), how)
