import pytest
from pyspark.sql import functions as F

from sqlcurate.llm import key_filters
from sqlcurate.llm.key_filters import flagged, only, without


@pytest.mark.parametrize("words", [1 << 18, 2])
def test_rows_with_and_without_a_key(spark, monkeypatch, words):
    """Also where there are more keys than bits: then all rows are joined."""
    monkeypatch.setattr(key_filters, "WORDS", words)
    rows = [(i % 400 if i % 7 else None, f"h{i % 3}", f"text {i}") for i in range(900)]
    listed = [(i, f"h{i % 3}") for i in range(0, 400, 3)] + [(None, "h1"), (None, "h1")]
    table = spark.createDataFrame(listed, "doc_id int, hash string").withColumn("text", F.lit("x"))
    df = spark.createDataFrame(rows, "doc_id int, hash string, text string").repartition(3)
    inside = lambda r: (r[0], r[1]) in set(listed)
    for found, want in ((without(df, table, ["doc_id", "hash"]), [r for r in rows if not inside(r)]), (only(df, table, ["doc_id", "hash"]), [r for r in rows if inside(r)])):
        assert found.columns == ["doc_id", "hash", "text"]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert without(df, table.filter("false"), ["doc_id", "hash"]).count() == 900
    assert only(df, table.filter("false"), ["doc_id", "hash"]).count() == 0


def test_few_rows_pass_the_filter(spark):
    table = spark.range(1000).select(F.col("id").alias("key"))
    asked = spark.range(60_000)
    assert flagged(asked, table, ["id"]).groupBy("_maybe").agg(F.count("*"), F.count_if(F.col("id") < 1000)).filter("NOT _maybe").first()[2] == 0
    assert flagged(asked, table, ["id"]).filter("_maybe").count() < 1050
    plan = without(asked, table.withColumnRenamed("key", "id"), ["id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
