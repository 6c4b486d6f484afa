"""Result cells and rows in the forms they are compared in."""

from pyspark.sql import Column, types as T, functions as F

from sqlcurate.functions.text import strip

# How an absent cell reads in the two comparisons. A present cell is lower-cased
# before it meets the first one, so the two cannot be confused.
ABSENT_KEY = "<NULL>"
ABSENT_TEXT = "None"

# A row is hashed HASHES times with different salts, and each 64-bit hash is cut into lanes of
# LANE_BITS, the last one narrower. Lanes this narrow can be added up over 2^43 rows before a BIGINT overflows, and then
# Spark raises instead of wrapping.
HASHES = 2
LANE_BITS = 20


def cell_text(column: Column, kind: T.DataType) -> Column:
    """A cell as text; whole floating-point numbers always read `n.0`."""
    text = column.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 2.0**53)
        return F.when(whole, F.concat(F.floor(column).cast("string"), F.lit(".0"))).otherwise(text)
    return text


def norm_cell(cell: Column) -> Column:
    return F.coalesce(strip(F.lower(cell)), F.lit(ABSENT_KEY))


def row_key(vals: Column) -> Column:
    """Row as compared for a match: cells normalised and sorted, so column order does not count."""
    return F.sort_array(F.transform(vals, norm_cell))


def strict_cells(vals: Column) -> Column:
    """Row as counted in a vote: column order and case kept."""
    return F.transform(vals, lambda cell: F.coalesce(cell, F.lit(ABSENT_TEXT)))


def strict_row(vals: Column) -> Column:
    """The same as text. JSON quoting keeps the borders of cells."""
    return F.to_json(strict_cells(vals))


def cell_preview(value: Column, width: int = 20) -> Column:
    return F.substring(value.cast("string"), 1, width)


def row_hashes(cells: Column) -> list[Column]:
    """Salted hashes of an array of cells without NULLs (a hash skips NULLs)."""
    return [F.xxhash64(F.lit(salt), cells) for salt in range(HASHES)]


def lanes(hashed: Column) -> list[Column]:
    mask = (1 << LANE_BITS) - 1
    return [F.shiftrightunsigned(hashed, at).bitwiseAND(F.lit(mask)) for at in range(0, 64, LANE_BITS)]
