"""Mixing sources to target weights in blocks of a fixed number of words.

Every source is one long stream of words, cut into blocks. A source gets as many slots as its target needs, and each
output shard, of a fixed number of slots, draws how many it takes of each source. The j-th slot of a source takes the
block to which a pseudorandom permutation of the source's block numbers sends j, with a new permutation for each round
through the source.
Blocks and slots meet in a join by (source, block number), so no source is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sqlcurate.llm.words import U64, mix, utf8, words_of
from sqlcurate.llm.workers import giving_back
from sqlcurate.sources.storage import stored

#: Words of a block; weights of the sources in code point order, repeating; how often a source may be used.
BLOCK_WORDS, WEIGHTS, MOST_USES = 128, (1, 2, 3), 3
SLOTS_PER_SHARD, SEED = 8192, 20240229
#: A source's documents are put in order within this many buckets by hash, and slots are made in chunks.
BUCKETS, CHUNK = 4096, 1 << 16
#: Running sums are made within this many numbers first.
STEP = 4096


class Mix(NamedTuple):
    """docs: doc_id, text_hash, source_no, size, start. sources: source, source_no, source_size, target, n_blocks,
    n_slots. slots: shard, slot, source_no, block."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """doc_id, source, size in words, and a hash that tells texts of one id apart."""

    @giving_back
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts = np.zeros(part.num_rows, np.int64)
            for words in words_of(*utf8(part.column(3)), lower=False):
                counts[words.first_row : words.first_row + words.rows] = words.counts()
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts)], ["doc_id", "source", "text_hash", "size"])

    kind = dict(docs.dtypes)[id_column]
    chosen = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"),
        F.xxhash64(f"`{text_column}`").alias("text_hash"), F.col(f"`{text_column}`").alias("text"),
    )
    return chosen.mapInArrow(batches, f"doc_id {kind}, source string, text_hash bigint, size bigint")


def numbered(sources: DataFrame) -> DataFrame:
    """source_no: the place of a source by code point, null last. Sorted in ranges, so no task sees all sources."""
    placed = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = parts.select("part", before.alias("before"))  # a row per range
    return placed.withColumn("part", part).join(firsts, "part").withColumn("source_no", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def with_targets(sources: DataFrame, weights: tuple[float, ...], most_uses: float) -> DataFrame:
    """target: a share of all words by weight; what exceeds most_uses times a source's size is shared anew."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most_uses))
    level = 0.0  # words per unit of weight; rises until no further source is full
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        left = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not left["weight"] or (new := (left["all"] - left["used"]) / left["weight"]) <= level:
            return sources.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("weight", "most")
        level = new


def permuted(source: np.ndarray, turn: np.ndarray, index: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """index under a pseudorandom permutation of 0..size-1 that depends on source, turn and seed.

    A Feistel network permutes the next power of four; values outside the range are sent on until they are inside.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(U64)
    mask = (U64(1) << half) - U64(1)
    key = mix(mix(source.astype(U64) + U64(seed)) + turn.astype(U64))
    value, todo = index.astype(U64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = value[todo] >> h, value[todo] & m
        for turn_no in range(4):
            left, right = right, left ^ (mix(right + k + U64(turn_no * 0x9E3779B9)) & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= size[todo].astype(U64)]
    return value.astype(np.int64)


def sums_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over rows of equal keys that come earlier by `order`, whole numbers that do not repeat.

    Sums of STEP numbers come first, so that no task holds all rows of a key.
    """
    part = F.expr(f"{order} div {STEP}")
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, part.alias("part")).agg(F.sum(value).alias("of_part"))
    parts = parts.select(*keys, "part", F.coalesce(F.sum("of_part").over(earlier(keys, "part")), F.lit(0)).alias("before_part"))
    within = F.coalesce(F.sum(value).over(earlier([*keys, "part"], order)), F.lit(0))
    return rows.withColumn("part", part).withColumn(name, within).join(parts, [*keys, "part"]).withColumn(name, F.col(name) + F.col("before_part")).drop("part", "before_part")


def drawn(sources: DataFrame, total: int, slots_per_shard: int, seed: int) -> DataFrame:
    """How many slots of each source an output shard draws: source_no, n_blocks, shard, count.

    The draw is multivariate hypergeometric, a multinomial one without putting back: a pseudorandom permutation shuffles
    the slots of all sources and a shard has the next `slots_per_shard`, so that shards are equally long and sources
    get all of their slots.
    """
    numbered = sums_before(sources.filter("n_slots > 0").select("source_no", "n_blocks", "n_slots"), [], "source_no", "n_slots", "ahead")
    chunks = numbered.select("*", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {CHUNK})")).alias("chunk"))

    @giving_back
    def shuffled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source, n_blocks, n_slots, ahead, chunk in part.itertuples(index=False):
                slots = ahead + np.arange(chunk * CHUNK, min(n_slots, (chunk + 1) * CHUNK))
                zeros = np.zeros(len(slots), np.int64)
                place = permuted(zeros, zeros, slots, np.full(len(slots), total), seed ^ 0x5DEECE66D)
                shard, count = np.unique(place // slots_per_shard, return_counts=True)
                yield pd.DataFrame({"source_no": source, "n_blocks": n_blocks, "shard": shard, "count": count})

    wanted = chunks.repartition("source_no", "chunk").select("source_no", "n_blocks", "n_slots", "ahead", "chunk")
    found = wanted.mapInPandas(shuffled, "source_no bigint, n_blocks bigint, shard bigint, count bigint")
    return found.groupBy("source_no", "n_blocks", "shard").agg(F.sum("count").alias("count"))


def dealt(sources: DataFrame, slots_per_shard: int, seed: int) -> DataFrame:
    """Slots of all shards: shard, slot, source_no, block.

    A shard draws its count of each source. The counts of earlier shards tell which slots of a source are its own,
    and the source's permutation tells their blocks; a permutation of the shard mixes its sources.
    """
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    counts = stored(drawn(sources, total, slots_per_shard, seed), "drawn")
    placed = sums_before(counts, ["source_no"], "shard", "count", "first")
    in_shard = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("count").over(in_shard), F.lit(0)))  # slots_per_shard rows at most
    slots = placed.select("shard", "at", "source_no", "n_blocks", "first", F.explode(F.expr("sequence(0L, count - 1)")).alias("i"))

    @giving_back
    def mapped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            shard, at, source, n, first, i = (part[c].to_numpy(np.int64) for c in ("shard", "at", "source_no", "n_blocks", "first", "i"))
            j = first + i
            size = np.minimum(slots_per_shard, total - shard * slots_per_shard)
            slot = permuted(shard, np.full(len(i), -1), at + i, size, seed)
            yield pd.DataFrame({"shard": shard, "slot": slot, "source_no": source, "block": permuted(source, j // n, j % n, n, seed)})

    return slots.mapInPandas(mapped, "shard bigint, slot bigint, source_no bigint, block bigint")


def mix_sources(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = WEIGHTS, most_uses: float = MOST_USES,
    slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED,
) -> Mix:
    """Plan of the mixture; `taken` and `mixed_texts` read it.

    Words are runs outside space and 0x09-0x0D. A null text has none; a null source is a source of its own. Rows
    that repeat are documents of their own; other columns are not read. A source without words has no target. An
    empty table gives an empty mixture. Documents are ordered by a hash of id and text, so reruns agree whatever
    the partitioning.
    """
    rows = stored(sized(docs, id_column, text_column, source_column), "sized")
    sources = with_targets(numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, most_uses)
    n_blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    n_slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0)
    sources = stored(sources.withColumn("n_blocks", n_blocks).withColumn("n_slots", n_slots.cast("long")), "targets")

    known = sources.select(F.col("source").alias("known"), "source_no")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("known"))).drop("known", "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS)))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("first"))  # BUCKETS rows a source
    before = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0))).join(buckets, ["source_no", "bucket"])
    placed = rows.select("doc_id", "text_hash", "source_no", "size", (F.col("first") + F.col("within")).alias("start"))
    return Mix(placed, sources, dealt(sources, slots_per_shard, seed))


def pieces(mix_: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The part of each block that each document gives: source_no, block, doc_id, text_hash, start, first, past.

    `first` and `past` count words of the document; `start` is the document's place in its source.
    """
    at = mix_.docs.filter("size > 0").select(
        "*", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block")
    )
    low = F.col("block") * block_words - F.col("start")
    return at.select(
        "source_no", "block", "doc_id", "text_hash", "start",
        F.greatest(low, F.lit(0)).alias("first"), F.least(low + block_words, F.col("size")).alias("past"),
    )


def taken(mix_: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (its words in the mixture, repeats counted)."""
    uses = mix_.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    used = pieces(mix_, block_words).join(uses, ["source_no", "block"])
    words = used.groupBy(F.col("source_no").alias("of"), F.col("start").alias("at")).agg(F.sum((F.col("past") - F.col("first")) * F.col("uses")).alias("taken"))
    # A place in a source has one document with words; those without words share places and take none.
    same = (F.col("source_no") == F.col("of")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    of_docs = mix_.docs.join(words, same, "left")
    known = mix_.sources.select("source_no", "source_size", "target")
    return of_docs.join(known, "source_no").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(mix_: Mix, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture: shard, slot, source, block, doc_ids, text (the block's words, joined by spaces).

    Rows with equal id and text give each piece twice; a block takes equal pieces once.
    """
    parts = pieces(mix_, block_words).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("source_no", "block", "start", "first", "past")).alias("parts")
    )  # as many as the document has blocks
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(f"`{text_column}`").alias("hash"), F.col(f"`{text_column}`").alias("text"))
    joined = texts.join(parts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    split = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    cut = joined.select("doc_id", split.alias("words"), "parts").select("doc_id", F.expr(
        "inline(transform(parts, p -> struct(p.source_no, p.block, p.start, array_join(slice(words, int(p.first + 1), int(p.past - p.first)), ' ') AS part)))"
    ))
    blocks = cut.groupBy("source_no", "block").agg(F.array_sort(F.collect_set(F.struct("start", "doc_id", "part"))).alias("parts"))
    blocks = blocks.select("source_no", "block", F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.part", " ").alias("text"))
    named = mix_.sources.select("source_no", "source")
    return mix_.slots.join(blocks, ["source_no", "block"]).join(named, "source_no").select("shard", "slot", "source", "block", "doc_ids", "text")
