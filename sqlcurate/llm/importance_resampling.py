"""Resampling towards a target distribution over hashed runs of words, with exact bucket totals.

A feature is a run of words, its bucket the CRC-32 of its bytes modulo the number of buckets. Frequent words and
frequent pairs are a head that is broadcast with their CRC states, a bounded list from one pass over all documents;
what is not in it gets its CRC from its bytes, many words at a time. Both ways give the same bucket, so totals are
exact whatever the head holds. (Words are looked up by 64-bit hash and length.)
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sqlcurate.llm.lookup import Lookup
from sqlcurate.llm.rows import named
from sqlcurate.llm.words import LOWER, SPACE_AND_MARKS, U64, Words, chain, utf8, words_of
from sqlcurate.sources.storage import stored

U32 = np.uint32
BUCKETS = 10_000
#: Head entries of each kind, in the broadcast and in what a task hands on.
HEAD = 4096
#: Kinds a task keeps before it drops the rarest of them; only the choice of the head depends on it.
COUNTED = 1 << 17
#: Words longer than this are handed to zlib one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=U32)
    for _ in range(8):
        table = np.where(table & U32(1), table >> U32(1) ^ U32(0xEDB88320), table >> U32(1))
    return table


CRC = _crc_table()


def continued(states: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what gave `states`, followed by raw[start:end], row by row."""
    out = states.astype(U32)
    size = end - start
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(raw[start[i] : end[i]], int(out[i]))
    short = np.flatnonzero((size > 0) & (size <= LONG))
    short = short[np.argsort(-size[short], kind="stable")]
    longer = np.searchsorted(-size[short], -np.arange(LONG + 1), "left")  # how many have more than k bytes
    crc, at = ~out[short], start[short]
    for k in range(LONG):
        if not (n := longer[k]):
            break
        crc[:n] = CRC[(crc[:n] ^ raw[at[:n] + k]) & U32(255)] ^ crc[:n] >> U32(8)
    out[short] = ~crc
    return out


@dataclass
class Head:
    """Hashes, byte lengths and CRC states of frequent words, and the same of frequent pairs."""

    words: np.ndarray
    lengths: np.ndarray
    crcs: np.ndarray
    pairs: np.ndarray
    pair_crcs: np.ndarray


class Features:
    """CRCs of all runs of 1 to `runs` words of a block of rows."""

    def __init__(self, head: Head, runs: int):
        self.runs = runs
        # One entry more, which the number -1 of what is not in the head leads to.
        self.lengths, self.crcs, self.pair_crcs = np.append(head.lengths, -1), np.append(head.crcs, U32(0)), np.append(head.pair_crcs, U32(0))
        self.words, self.pairs = Lookup(head.words), Lookup(head.pairs)

    def of(self, block: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: its rows and its CRCs."""
        raw = LOWER[block.bytes]
        found = self.words.find(block.hash)
        found[self.lengths[found] != block.end - block.start] = -1
        crcs = self.crcs[found]
        tail = np.flatnonzero(found < 0)
        crcs[tail] = continued(np.zeros(len(tail), U32), raw, block.start[tail], block.end[tail])
        yield block.row, crcs
        at, hashes, space = np.arange(len(crcs)), block.hash, U32(ord(" "))
        for length in range(2, self.runs + 1):
            last = at + length - 1
            inside = last < len(block.row)
            inside[inside] = block.row[at[inside]] == block.row[last[inside]]
            at, crcs, hashes, last = at[inside], crcs[inside], hashes[inside], last[inside]
            hashes = chain(hashes, block.hash[last]) if len(at) else hashes
            known = self.pairs.find(hashes) if length == 2 else np.full(len(at), -1, np.int32)
            spaced = ~(CRC[(~crcs ^ space) & U32(255)] ^ ~crcs >> U32(8))
            crcs = np.where(known >= 0, self.pair_crcs[known], spaced)
            tail = np.flatnonzero(known < 0)
            crcs[tail] = continued(spaced[tail], raw, block.start[last[tail]], block.end[last[tail]])
            yield block.row[at], crcs


def head_of(docs: DataFrame, text_column: str, runs: int, size: int = HEAD) -> Head:
    """The most frequent words, and pairs if runs of two are asked for; each task hands on its `size` most frequent."""

    def most(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        return np.argpartition(-counts, n)[:n] if len(keys) > n else np.arange(len(keys))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(np.empty(0, U64), np.empty(0, np.int64), np.empty((0, 2), np.int64)) for _ in range(min(runs, 2))]
        empty = Head(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, U32), np.empty(0, U64), np.empty(0, U32))
        features = Features(empty, min(runs, 2))
        for part in parts:
            for block in words_of(*utf8(part.column(0)), between=SPACE_AND_MARKS):
                hashes, lengths = block.hash, block.end - block.start
                for k, (_, crcs) in enumerate(features.of(block)):
                    if k:
                        at = np.flatnonzero(block.row[1:] == block.row[:-1])
                        hashes, lengths = chain(block.hash[at], block.hash[at + 1]) if len(at) else block.hash[:0], np.zeros(len(at), np.int64)
                    own, first, n = np.unique(hashes, return_index=True, return_counts=True)
                    keys = np.concatenate([kinds[k][0], own])
                    what = np.concatenate([kinds[k][2], np.stack([lengths[first], crcs[first].astype(np.int64)], axis=1)])
                    keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
                    counts = np.bincount(which, np.concatenate([kinds[k][1], n]), len(keys)).astype(np.int64)
                    kept = most(keys, counts, COUNTED)
                    kinds[k] = keys[kept], counts[kept], what[first][kept]
        for k, (keys, counts, what) in enumerate(kinds):
            kept = most(keys, counts, size)
            columns = [np.full(len(kept), k), keys[kept].view(np.int64), counts[kept], what[kept, 0], what[kept, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "hash", "n", "length", "crc"])

    counted = docs.select(named(text_column).cast("string").alias("text")).mapInArrow(
        batches, "kind bigint, hash bigint, n bigint, length bigint, crc bigint"
    )
    summed = counted.groupBy("kind", "hash", "length", "crc").agg(F.sum("n").alias("n"))
    taken = [summed.filter(F.col("kind") == k).orderBy(F.desc("n"), "hash").limit(size).collect() for k in range(min(runs, 2))]
    words, pairs = taken[0], taken[1] if runs > 1 else []
    column = lambda rows, name, kind: np.array([r[name] for r in rows], np.int64).astype(kind)
    return Head(
        column(words, "hash", np.int64).view(U64), column(words, "length", np.int64), column(words, "crc", U32),
        column(pairs, "hash", np.int64).view(U64), column(pairs, "crc", U32),
    )


def bucket_totals(texts: DataFrame, text_column: str, head, runs: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows; a task hands on one number per bucket, the driver gets one per bucket."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(Head(*head.value), runs), np.zeros(buckets, np.int64)
        for part in parts:
            for block in words_of(*utf8(part.column(0)), between=SPACE_AND_MARKS):
                for _, crcs in features.of(block):
                    total += np.bincount(crcs % U32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counted = texts.select(named(text_column).cast("string").alias("text")).mapInArrow(batches, "bucket bigint, n bigint")
    total = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[bucket] = n
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, with one added to each bucket."""
    buckets, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [float(b + 1) * float(s + buckets) / (float(a + 1) * float(t + buckets)) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, text_column: str, head, gains, runs: int, kept: list[Column], schema: str) -> DataFrame:
    """The columns `kept`, with n_words, n_features and weight, the sum of gains over a text's features."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(Head(*head.value), runs), gains.value
        for part in parts:
            n = part.num_rows
            words, found, weight = (np.zeros(n, np.int64) for _ in range(3))
            for block in words_of(*utf8(part.column(0)), between=SPACE_AND_MARKS):
                own = slice(block.first_row, block.first_row + block.rows)
                words[own] = block.counts()
                for row, crcs in features.of(block):
                    sums = np.concatenate([[0], np.cumsum(gain[crcs % U32(len(gain))])])
                    bounds = np.searchsorted(row, np.arange(block.rows + 1))
                    found[own] += np.diff(bounds)
                    weight[own] += np.diff(sums[bounds])
            more = [pa.array(a, pa.int64()) for a in (words, found, weight)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *more], [*part.schema.names[1:], "n_words", "n_features", "weight"])

    rows = docs.select(named(text_column).cast("string").alias("text"), *kept)
    return rows.mapInArrow(batches, f"{schema}, n_words bigint, n_features bigint, weight bigint")


def with_ranks(rows: DataFrame, eligible: Column, order: list[Column], share: int) -> DataFrame:
    """Adds `rank`: 1, 2, 3, ... in `order` for the first `share` percent of eligible rows, null for all others.

    Rows are dealt to tasks by ranges of the order and numbered there; the numbers before a range are those of one
    row per range. The numbered rows are stored, as ranges need not be the same when they are drawn again.
    """
    first = [F.col("eligible").desc(), *order]
    dealt = rows.withColumn("eligible", eligible).repartitionByRange(*first).sortWithinPartitions(*first)
    dealt = stored(dealt.withColumn("nth", F.monotonically_increasing_id()), "ranked")  # range number, then 33 bits of place
    ranges = dealt.groupBy(F.shiftright("nth", 33).alias("range")).agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    drawn = (ranges.agg(F.sum("n_eligible")).first()[0] or 0) * share // 100
    place = F.col("before") + F.col("nth").bitwiseAND((1 << 33) - 1) + 1
    joined = dealt.join(before, F.shiftright("nth", 33) == F.col("range"))
    return joined.withColumn("rank", F.when(F.col("eligible") & (place <= drawn), place)).drop("range", "before", "nth", "eligible")


def resample(
    docs: DataFrame, target: DataFrame, share: int = 10, runs: int = 2, least_words: int = 20, seed: int = 2024,
    buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text", head: int = HEAD,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document.

    Words are runs of letters, digits and non-ASCII, A-Z lower-cased. The weight adds up the gains of a text's
    features; with the noise that seed and id give, the highest scores are a draw without replacement by weight. Drawn
    are `share` percent of the documents with `least_words` words or more, highest scores first, ties by id; rows
    equal in both too take any order. A null text has no words, a null id counts as empty in the noise and comes last
    in ties. Without target features all gains come from the corpus alone; an empty table gives no rows. Other columns
    are not read.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(astuple(head_of(docs, text_column, runs, head)))
    corpus = bucket_totals(docs, text_column, shared, runs, buckets)
    gains = spark.sparkContext.broadcast(bucket_gains(corpus, bucket_totals(target, target_text, shared, runs, buckets)))
    kind = docs.schema[id_column].dataType.simpleString()
    weighed = weights(docs, text_column, shared, gains, runs, [named(id_column).alias("doc_id")], f"doc_id {kind}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise.cast("long")), "scored")  # read twice: for the ranges, and to rank
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc()]
    ranked = with_ranks(scored, F.col("n_words") >= least_words, order, share)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
