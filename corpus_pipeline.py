"""A corpus in five stages: quality, near duplicates, benchmark leaks, personal data, mixture.

Every stage takes what the one before has kept, written as Parquet and read again. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcurate.llm.decontamination import decontaminate
from sqlcurate.llm.jaccard_join import similar
from sqlcurate.llm.key_filters import only, without
from sqlcurate.llm.kneser_ney import judge
from sqlcurate.llm.mixing import mix_sources, mixed_texts
from sqlcurate.llm.rows import boxed
from sqlcurate.llm.sanitising import sanitised
from sqlcurate.llm.workers import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not too high for their language.

    A verdict follows from id, language and text, so rejected rows are named by these; places in files would change
    with the number of cores.
    """
    keys = ["doc_id", "lang", "hash"]
    judged = judge(docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("hash")), spark.read.parquet(f"{sf_dir}/labels.parquet"), carried=keys)
    gone = stored(judged.filter("NOT kept").select("doc.*").distinct(), "rejected")
    return without(boxed(docs, doc_id=F.col("doc_id"), lang=F.col("lang"), hash=F.xxhash64("text")), gone, keys).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that shares 0.8 of its five-word shingles.

    Rows are told apart by id and text. Of rows that are equal in both the first in the order of all columns stays;
    texts without words are no group.
    """
    keys = ["doc_id", "hash"]
    rows = boxed(docs, doc_id=F.col("doc_id"), hash=F.xxhash64("text"))
    groups = similar(rows.select(F.struct(*keys).alias("id"), "doc.text"), id_column="id").filter("n_shingles > 0")
    seen = stored(groups.groupBy("id").agg(F.min("component_id").alias("least"), F.count("*").alias("n")).filter("least <> id OR n > 1"), "duplicates")
    left = without(rows, seen.select("id.*"), keys).select("doc.*")
    again = only(rows, seen.filter("least = id").select("id.*"), keys)
    return left.unionByName(again.groupBy(*keys).agg(F.min("doc").alias("doc")).select("doc.*"))


def leaks_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced; n_chars is that of the new text."""
    return sanitised(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of text in the target weights of their sources: shard, slot, source, block, doc_ids, text."""
    return mixed_texts(mix_sources(docs), docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", leaks_removed),
    ("private_data", private_data),
    ("source_mixing", mixture),
]

#: The classifier and the permutations have no SQL form; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
