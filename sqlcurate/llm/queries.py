"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlcurate.llm.decontamination import leaks
from sqlcurate.llm.importance_resampling import resample
from sqlcurate.llm.jaccard_join import similar
from sqlcurate.llm.kneser_ney import judge
from sqlcurate.llm.language_id import identify
from sqlcurate.llm.mixing import mix_sources, taken
from sqlcurate.llm.pitman_yor import score_texts
from sqlcurate.llm.quality_rules import judge_quality
from sqlcurate.llm.ranked_search import ranked_search
from sqlcurate.llm.sanitising import KINDS, private_spans, span_text
from sqlcurate.llm.token_counts import count_tokens
from sqlcurate.llm.token_files import read_token_files, with_global_starts, write_token_files
from sqlcurate.llm.warc import assemble, write_warc
from sqlcurate.sources.storage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(of: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


@query
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = judge_quality(table(spark, sf, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "votes", "p_good")


@query
def op5_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return taken(mix_sources(table(spark, sf, "documents")))


@query
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    found = identify(table(spark, sf, "documents"), eligible=fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op6_warc_transactions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf, "pages"), path)
    revisit = F.col("capture.type") == "revisit"
    # A response's figures are those of the bytes read; a revisit has no bytes, its records name them.
    return assemble(spark, path, payloads=False).select(
        F.col("metadata.page_id").alias("page_id"),
        F.when(revisit, F.col("metadata.payload_length")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("capture.payload_digest", ":", -1)).otherwise(F.col("capture.found_digest")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.nullif(F.regexp_extract("capture.refers_to", r"response:(-?\d+)/", 1), F.lit("")).cast("long").alias("refers_to"),
    )


ORACLES["op6_warc_transactions"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query
def op4_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles")


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return similar(table(spark, sf, "documents"), length=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query
def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    judged = judge(table(spark, sf, "documents"), table(spark, sf, "labels"), carried=["doc_id", "lang"])
    perplexity = F.pow(10.0, -F.col("log10") / F.col("tokens")).alias("perplexity")
    return judged.select("doc.doc_id", "doc.lang", F.col("tokens").alias("n_tokens"), perplexity, "kept")


@query
def op7_private_data(spark: SparkSession, sf: str) -> DataFrame:
    found = private_spans(table(spark, sf, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint) AS n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query
def op1_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    found = score_texts(table(spark, sf, "documents"), train=fold(5) != 1)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    found = resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), share=10, runs=1, least_words=20, seed=2024, buckets=10_000)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 byte by byte over distinct words; a table entry is eight steps of its polynomial.
ORACLES["op11_importance_resampling"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS nth, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), f AS (
  SELECT nth, unnest(words) AS word FROM d
), g AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), steps AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM range(256) AS r(i)
), w AS (
  SELECT word, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(entries[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM f UNION SELECT word FROM g), steps
), s AS (
  SELECT bucket, count(*) AS n FROM f JOIN w USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM g JOIN w USING (word) GROUP BY bucket
), sums AS (
  SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all
), gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums
), weighed AS (
  SELECT nth, sum(gain)::BIGINT AS weight FROM f JOIN w USING (word) JOIN gains USING (bucket) GROUP BY nth
), scored AS (
  SELECT nth, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (nth)
), drawn AS (
  SELECT nth, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (nth)
"""


@query
def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10, length_share=90)


ORACLES["op12_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS nth, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), size AS (
  SELECT count(*) FILTER (WHERE len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_all FROM d
), i AS (
  SELECT row_number() OVER () AS item, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS words
  FROM benchmark
), asked AS (
  SELECT item, item_id, unnest(words) AS word FROM i
), tf AS (
  SELECT nth, doc_id, n, word, count(*) AS tf FROM (SELECT nth, doc_id, len(words)::BIGINT AS n, unnest(words) AS word FROM d)
  WHERE word IN (SELECT word FROM asked) GROUP BY ALL
), w AS (
  SELECT word, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY word, n_docs
), scored AS (
  SELECT item, item_id, nth, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all))))::BIGINT AS score
  FROM tf JOIN w USING (word) JOIN asked USING (word), size GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token_files")
    write_token_files(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return with_global_starts(read_token_files(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
