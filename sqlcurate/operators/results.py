"""Result sets of executed statements: capping, fingerprints, equality.

`exec_rows(exec_id, row_no, vals)` holds the rows of all results and is by far the largest table.
It is never joined or collected per execution here: rows become hashes where they are read, and
what is shuffled is keyed by (execution, row), so one huge result spreads over all tasks.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sqlcurate.functions.cells import HASHES, lanes, row_hashes, row_key, strict_cells
from sqlcurate.sources.storage import stored

# Fixed value: the cap of the runs whose reports are compared with. Nothing is capped unless asked for.
MAX_RESULT_ROWS = 50_000


def cap_rows(exec_rows: DataFrame, cap: int = MAX_RESULT_ROWS, dense: bool = True) -> DataFrame:
    """First `cap` rows of every result.

    With `dense` row numbers (0, 1, 2, ... per execution) this is a
    filter that reaches the scan. Otherwise `row_no` may have gaps but is unique per execution.
    Rows are then counted per bucket of row numbers, and only the bucket in which an execution
    reaches the cap is ranked, so no task has to hold or sort a whole result.
    """
    if dense:
        return exec_rows.filter(F.col("row_no") < cap)
    bucketed = exec_rows.withColumn("_bucket", F.shiftright(F.col("row_no"), 16))
    earlier = Window.partitionBy("exec_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Buckets that reach past the cap: the one it falls into, and those to drop as a whole.
    late = (
        bucketed.groupBy("exec_id", "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter(F.col("_before") + F.col("_n") > cap)
        .select("exec_id", "_bucket", "_before")
    )
    in_bucket = Window.partitionBy("exec_id", "_bucket").orderBy("row_no")
    last_kept = (
        bucketed.select("exec_id", "_bucket", "row_no")
        .join(late.filter(F.col("_before") < cap), ["exec_id", "_bucket"])
        .withColumn("_rank", F.row_number().over(in_bucket))
        .filter(F.col("_before") + F.col("_rank") == cap)
        .select("exec_id", "_bucket", F.col("row_no").alias("_last"))
    )
    cuts = late.select("exec_id", "_bucket", F.lit(True).alias("_late")).join(last_kept, ["exec_id", "_bucket"], "left")
    return (
        bucketed.join(cuts, ["exec_id", "_bucket"], "left")
        .filter(F.col("_late").isNull() | (F.col("row_no") <= F.col("_last")))
        .select(*exec_rows.columns)
    )


def mark_truncated(executions: DataFrame, exec_rows: DataFrame, cap: int | None = MAX_RESULT_ROWS) -> DataFrame:
    """Row counts and the note on results over the cap, if there is one. Such a result stays ok."""
    counts = exec_rows.groupBy("exec_id").agg(F.count("*").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    over = F.lit(False) if cap is None else n > cap
    return (
        executions.drop("truncated").join(counts, "exec_id", "left")
        .withColumn("n_kept", n if cap is None else F.least(n, F.lit(cap)))
        .withColumn("truncated", over)
        .withColumn("error", F.when(over, F.lit(f"Results truncated to {cap} rows")).otherwise(F.col("error")))
        .drop("_n")
    )


def fingerprint_results(exec_rows: DataFrame, executions: DataFrame) -> DataFrame:
    """Two fingerprints per execution, made in one pass over the rows.

    `set_print` is equal for results with equal sets of row keys (matching), `bag_print` for
    results with equal multisets of strict rows (voting). A row becomes two salted 64-bit hashes,
    and a print is the sum of these over the rows, lane by lane: it does not depend on row order,
    is aggregated on the map side, and never needs the rows of one result in one place. An empty
    result has the prints of zero rows.
    """
    # Normalised once per row, hashed in a projection of its own.
    cells = exec_rows.select("exec_id", row_key(F.col("vals")).alias("_key"), strict_cells(F.col("vals")).alias("_row"))
    rows = cells.select(
        "exec_id",
        *[hashed.alias(f"_key{i}") for i, hashed in enumerate(row_hashes(F.col("_key")))],
        *[hashed.alias(f"_row{i}") for i, hashed in enumerate(row_hashes(F.col("_row")))],
    )
    keys = [f"_key{i}" for i in range(HASHES)]

    def summed(prefix: str) -> dict[str, Column]:
        parts = [lane for i in range(HASHES) for lane in lanes(F.col(f"{prefix}{i}"))]
        return {f"{prefix}_sum{i}": F.sum(part) for i, part in enumerate(parts)}

    bag, bag_of_keys = summed("_row"), summed("_key")
    per_key = rows.groupBy("exec_id", *keys).agg(
        F.count("*").alias("_n"), *[total.alias(name) for name, total in bag.items()]
    )
    per_exec = per_key.groupBy("exec_id").agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_keys"),
        *[total.alias(name) for name, total in bag_of_keys.items()],
        *[F.sum(name).alias(name) for name in bag],
    )

    def folded(*parts: str) -> Column:
        return F.sha2(F.concat_ws(",", *[F.coalesce(F.col(part), F.lit(0)) for part in parts]), 256)

    return executions.join(per_exec, "exec_id", "left").select(
        *[F.col(name) for name in executions.columns],
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        folded("n_keys", *bag_of_keys).alias("set_print"),
        folded("n_rows", *bag).alias("bag_print"),
    )


def key_prints(keys: DataFrame) -> DataFrame:
    """`(exec_id, n, print)` of distinct row keys; equal sets have equal prints, unequal ones may."""
    total = F.sum(F.xxhash64("row_key").cast("decimal(38,0)"))
    return keys.groupBy("exec_id").agg(F.count("*").alias("n"), F.concat_ws(",", F.count("*"), total).alias("print"))


def result_classes(keys: DataFrame, prints: DataFrame) -> DataFrame:
    """`(exec_id, class_id)`: executions of one class have equal sets of rows, decided on the rows.

    `keys(exec_id, row_key)` are distinct and stored, `prints(exec_id, n, print)` as from `key_prints`. Executions of
    one print are compared with the smallest of them, so a row is read once for itself and, in that one, met by those of
    its print. What differs from it although the prints are equal makes classes of its own in a further round; with
    good prints the first is the last.
    """
    left, settled = prints.select("exec_id", "n", "print"), []
    while True:
        least = left.groupBy("print").agg(F.min(F.struct("exec_id", "n")).alias("_least"))
        asked = left.join(least, "print").select("exec_id", "n", "print", F.col("_least.exec_id").alias("class_id"), F.col("_least.n").alias("_of"))
        others = asked.filter("exec_id <> class_id AND n = _of").select("exec_id", "class_id")
        of_class = keys.select(F.col("exec_id").alias("class_id"), "row_key")
        shared = keys.join(others, "exec_id").join(of_class, ["class_id", "row_key"]).groupBy("exec_id").agg(F.count("*").alias("_shared"))
        same = (F.col("exec_id") == F.col("class_id")) | F.coalesce(F.col("_shared") == F.col("n"), F.lit(False))
        compared = stored(asked.join(shared, "exec_id", "left").withColumn("_same", same), "classes")
        settled.append(compared.filter("_same").select("exec_id", "class_id"))
        left = compared.filter("NOT _same")
        if left.isEmpty():
            return reduce(DataFrame.union, settled)


def match_results(exec_rows: DataFrame, pairs: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """Set equality of two results, decided on the rows themselves.

    `pairs(pair_id, pred_exec_id, gold_exec_id)`. Returns the number of distinct rows on either side and on both; a
    pair with no rows at all matches. Executions are first put into classes of equal results (`prints` replaces the
    prints that suggest them), and pairs become pairs of classes. Rows are joined for each two classes that differ,
    however many pairs and candidates ask for them; a pair within a class needs none.
    """
    keys = stored(exec_rows.select("exec_id", row_key(F.col("vals")).alias("row_key")).distinct(), "row_keys")
    prints = stored(key_prints(keys) if prints is None else prints, "key_prints")
    classes = prints.join(result_classes(keys, prints), "exec_id").select("exec_id", "n", "class_id")

    def side(name: str) -> DataFrame:
        return classes.select(F.col("exec_id").alias(f"{name}_exec_id"), F.col("n").alias(f"n_{name}"), F.col("class_id").alias(f"_{name}"))

    asked = stored(pairs.join(side("gold"), "gold_exec_id", "left").join(side("pred"), "pred_exec_id", "left"), "class_pairs")
    unlike = asked.filter("_gold <> _pred").select("_gold", "_pred").distinct()
    pred = keys.select(F.col("exec_id").alias("_pred"), "row_key")
    gold = keys.select(F.col("exec_id").alias("_gold"), "row_key")
    both = unlike.join(pred, "_pred").join(gold, ["_gold", "row_key"]).groupBy("_gold", "_pred").agg(F.count("*").alias("_both"))
    counted = asked.join(both, ["_gold", "_pred"], "left")
    n_both = F.when(F.col("_gold") == F.col("_pred"), F.col("n_gold")).otherwise(F.coalesce("_both", F.lit(0)))
    n = {name: F.coalesce(F.col(name), F.lit(0)) for name in ("n_gold", "n_pred")} | {"n_both": n_both}
    return counted.select(
        *[F.col(name) for name in pairs.columns],
        *[column.alias(name) for name, column in n.items()],
        ((n["n_gold"] == n_both) & (n["n_pred"] == n_both)).alias("is_match"),
    )
