import json
import random
import re

import pytest

from pyspark.sql import functions as F

from sqlcurate.sources import readers, writers
from sqlcurate.sources.documents import document_entries, pieces_of
from sqlcurate.sources.storage import scratch_path, stored


def test_questions_from_documents(spark, tmp_path):
    entry = {"question": "Café?", "query": "SELECT 'é'", "db_id": "d"}
    (tmp_path / "train_spider.json").write_text(json.dumps([entry, {**entry, "question": "b"}], indent=2))
    (tmp_path / "dev.json").write_text(json.dumps([entry]))
    rows = readers.load_questions(spark, str(tmp_path), document=True).collect()
    assert sorted((row.split, row.question) for row in rows) == [("dev", "Café?"), ("train", "Café?"), ("train", "b")]
    assert len({row.question_id for row in rows}) == 3 and {row.gold_sql for row in rows} == {"SELECT 'é'"}


def test_gold_tsv_keeps_quotes(spark, tmp_path):
    lines = ['SELECT a FROM t WHERE b = "x"\tone', "SELECT 'it''s' \\ \"\ttwo", '"quoted"\tthree']
    (tmp_path / "gold.sql").write_text("\n".join(lines))
    rows = readers.load_gold_tsv(spark, str(tmp_path / "gold.sql")).collect()
    assert [f"{row.gold_sql}\t{row.db_id}" for row in rows] == lines


ENTRIES = [{"question": "q1", "db_id": "a", "gold_sql": "g"}, {"question": "q2", "db_id": "b", "query": "h", "is_correct": False}]


@pytest.mark.parametrize("document, expected", [
    (ENTRIES, {("q1", None), ("q2", None)}),
    ({"total": 2, "errors": {"joins": ENTRIES[:1], "other": ENTRIES[1:], "none": []}}, {("q1", "joins"), ("q2", "other")}),
])
def test_error_documents(spark, tmp_path, document, expected):
    (tmp_path / "errors.json").write_text(json.dumps(document, indent=2))
    rows = readers.load_errors(spark, str(tmp_path / "errors.json"), layout="document").collect()
    assert {(row.question, row.error_category) for row in rows} == expected
    (tmp_path / "lines.json").write_text(json.dumps(document) + "\n" + json.dumps(document) + "\n")
    assert readers.load_errors(spark, str(tmp_path / "lines.json"), layout="documents").count() == 4


def test_errors_get_ids_and_gold(spark, tmp_path):
    lines = [{"question": "q", "db_id": "a", "query": "old"}] * 2 + [{"question_id": "7", "question": "q", "db_id": "a", "gold_sql": "new", "vote_count": 3, "reasoning": "r"}]
    (tmp_path / "errors.json").write_text("\n".join(map(json.dumps, lines)))
    rows = readers.load_errors(spark, str(tmp_path / "errors.json")).collect()
    assert sorted(row.gold_sql for row in rows) == ["new", "old", "old"] and len({row.question_id for row in rows}) == 3
    [given] = [row for row in rows if row.question_id == "7"]
    assert (given.vote_count, given.reasoning) == (3, "r")


def test_equal_questions_stay_apart(spark, tmp_path):
    entry = {"question": "Same?", "query": "SELECT 1", "db_id": "d"}
    (tmp_path / "train_spider.json").write_text("\n".join([json.dumps({**entry, "no": "x"})] * 2))
    (tmp_path / "dev.json").write_text(json.dumps({**entry, "no": "y"}))
    assert len({row.question_id for row in readers.load_questions(spark, str(tmp_path)).collect()}) == 3
    assert sorted(row.question_id for row in readers.load_questions(spark, str(tmp_path), id_column="no").collect()) == ["x", "x", "y"]


def test_report_and_errors_round_trip(spark, tmp_path):
    verdicts = spark.createDataFrame(
        [("q1", "a", "g", "p", True, None), ("q2", "b", "g", None, False, "failed")],
        "question string, db_id string, gold_sql string, predicted_sql string, is_correct boolean, error string",
    )
    writers.write_errors(verdicts, f"{tmp_path}/errors")
    [row] = readers.load_errors(spark, f"{tmp_path}/errors", layout="lines").collect()
    assert (row.question, row.predicted_sql, row.error, row.is_correct) == ("q2", None, "failed", False)
    runs = spark.createDataFrame([("m", 1, 2, 0.5)], "model string, correct long, total long, accuracy double")
    writers.write_report(runs, verdicts, f"{tmp_path}/report")
    [run] = readers.load_reports(spark, f"{tmp_path}/report/runs").collect()
    assert (run.model, run.correct, run.accuracy, run.k_candidates) == ("m", 1, 0.5, None) and run.timestamp
    assert spark.read.parquet(f"{tmp_path}/report/verdicts").count() == 2


def test_reports_with_different_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"model": "m", "accuracy": 0.6, "correct": 6, "total": 10}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"model": "n", "k_candidates": 16, "strategy": "vote", "accuracy": 0.7, "results": []}, indent=2))
    rows = {row.model: row for row in readers.load_reports(spark, str(tmp_path), document=True).collect()}
    assert rows["m"].k_candidates is None and rows["n"].k_candidates == 16


def test_sft_round_trip(spark, tmp_path):
    text = 'with "quotes",\n\ttabs and {braces}'
    sft = spark.createDataFrame([(1, "correct", text, "", "o")] * 2, "question_id long, origin string, instruction string, input string, output string")
    writers.write_sft(sft, f"{tmp_path}/sft")
    rows = spark.read.json(f"{tmp_path}/sft").collect()
    assert [row.asDict() for row in rows] == [{"instruction": text, "input": "", "output": "o"}] * 2


def test_scratch_folder_is_the_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    path = scratch_path(spark, "x")
    assert path.startswith(root) and path != scratch_path(spark, "x")
    kept = stored(spark.range(5).select(F.col("id").alias("a")), "numbers")
    assert kept.count() == 5 and kept.columns == ["a"]


def test_numbers_run_on_over_parts(spark):
    rows = [("hot", i % 7) for i in range(300)] + [("b", 3), ("b", 3), ("b", 5), (None, 1), (None, 2), ("c", 0)]
    got = {}
    for row in readers.numbered(spark.createDataFrame(rows, "k string, part int").repartition(5), ["k"], "part").filter("k IS NOT NULL").collect():
        got.setdefault(row.k, []).append((row._nth, row.part))
    assert {k: [n for n, _ in sorted(v)] for k, v in got.items()} == {"hot": [*range(1, 301)], "b": [1, 2, 3], "c": [1]}
    assert all([part for _, part in sorted(v)] == sorted(part for _, part in v) for v in got.values())


def test_equal_questions_of_many_tasks(spark, tmp_path):
    """300,000 equal entries, cut into many parts: no window holds more of them than one part."""
    n = 300_000
    entry = F.to_json(F.struct(F.lit("q?").alias("question"), F.lit("SELECT 1").alias("query"), F.lit("d").alias("db_id")))
    spark.range(n).select(entry.alias("value")).coalesce(1).write.text(f"{tmp_path}/train_spider.json")
    spark.range(3).select(entry.alias("value")).coalesce(1).write.text(f"{tmp_path}/dev.json")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        loaded = readers.load_questions(spark, str(tmp_path))
        ids = loaded.agg(F.count("*"), F.countDistinct("question_id")).first()
        want = spark.range(1, n + 1).select(F.sha2(F.concat_ws("\x01", F.lit("train"), F.lit("d"), F.lit("q?"), F.lit("SELECT 1"), F.col("id").cast("string")), 256).alias("question_id"))
        assert tuple(ids) == (n + 3, n + 3)
        assert loaded.filter("split = 'train'").join(want, "question_id", "left_anti").isEmpty()
        windows = re.findall(r"windowspecdefinition\(([^)]*)", loaded._jdf.queryExecution().optimizedPlan().toString())
        assert windows and not [w for w in windows if "_part" not in w]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_null_and_empty_fields_do_not_share_an_id(spark, tmp_path):
    for name in ("train_spider.json", "dev.json"):
        (tmp_path / name).write_text("\n".join(map(json.dumps, [{"question": "q", "db_id": ""}, {"question": "q"}, {"question": "q", "query": "", "db_id": ""}])))
    assert readers.load_questions(spark, str(tmp_path)).select("question_id").distinct().count() == 6


def wild_entries(n, seed):
    """Entries with quotes, braces, brackets and backslashes in their texts, and nested fields."""
    pick = random.Random(seed)
    parts = ["}", "{", "[", "]", '"', "\\", ",", ":", '": [{', "é", " ", "x", "\n", '\\"}', "SELECT"]
    text = lambda: "".join(pick.choices(parts, k=pick.randrange(12)))
    more = lambda: pick.choice([{}, {"extra": {"a": [{"b": text()}, {}], "c": {}}}, {"list": [[], [text()]]}])
    return [{"question_id": str(i), "question": text(), "db_id": text(), "gold_sql": text()} | more() for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("block", [1 << 27, 3000])
def test_documents_are_cut_into_their_entries(spark, tmp_path, indent, block):
    entries = wild_entries(200, 3)
    groups = {"a": entries[:50], "none": [], 'q"}[{': entries[50:51], "b": entries[51:]}
    documents = {
        "list": entries, "map": {"errors": groups}, "empty": [], "nothing": {"errors": {}}, "no_errors": {"total": 3, "note": "} {"},
        "more": {"total": 5, "note": 'a } " {', "runs": [{"x": 1}, {"y": {"z": []}}], "summary": {"m": {"n": {"o": {}}}}, "errors": groups, "after": {"k": [{"q": 1}]}},
    }
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        for name, document in documents.items():
            (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False) + "\n")
            lists = {None: document} if isinstance(document, list) else document.get("errors", {})
            got = document_entries(spark, str(tmp_path / f"{name}.json")).collect()
            key = lambda pair: (str(pair[0]), int(pair[1]["question_id"]))
            assert sorted(((r.category, json.loads(r.entry)) for r in got), key=key) == sorted(((c, e) for c, some in lists.items() for e in some), key=key), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_large_document_is_read_by_all_tasks(spark, tmp_path):
    """200,000 entries in one line: the same as in the lines layout, and no task holds them all."""
    n = 200_000
    rows = spark.range(n).select(F.concat(F.lit('{"question_id": "'), "id", F.lit('", "question": "is } the \\\\\\" end?", "db_id": "d"}')).alias("value"))
    lines = [r.value for r in rows.collect()]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    (tmp_path / "document.json").write_text("[" + ", ".join(lines) + "]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        pieces = pieces_of(spark, str(tmp_path / "document.json"))
        sizes = [r["count"] for r in pieces.groupBy("block").count().collect()]
        assert len(sizes) > 8 and max(sizes) < n / 4
        whole, flat = (readers.load_errors(spark, str(tmp_path / f"{name}.json"), layout=layout) for name, layout in (("document", "document"), ("lines", "lines")))
        summary = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("question_id", "question", "db_id").cast("decimal(38,0)"))).first()
        assert summary(whole) == summary(flat) and summary(whole)[0] == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
