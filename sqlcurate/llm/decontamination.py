"""Benchmark decontamination by greedy string tiling.

Documents that share a run of SEED words with a benchmark item are candidates: runs of both sides meet in a join.
Each candidate pair with enough of them is tiled: the longest match of unmarked words is marked on both sides, again
and again, until no match of SEED words is left. A document leaks an item if its tiles cover enough of the item, in any order.

Words are runs of letters and digits in lower case; runs are compared by running Karp-Rabin hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sqlcurate.llm.lookup import bits_at
from sqlcurate.llm.rows import boxed, named
from sqlcurate.llm.words import SPACE_AND_MARKS, U64, mix, rolling, utf8, words_of
from sqlcurate.llm.workers import giving_back, stored

#: Shortest match in words (an item of fewer words matches whole); share of an item's words that makes a leak.
SEED, COVERAGE = 5, 0.5
#: Size of the filter that spares documents without seeds the join. It is fixed: with more seeds it lets more pass.
FILTER_BITS = 1 << 24


def seeds_of(words: np.ndarray, length: int) -> np.ndarray:
    return rolling(words, length).view(np.int64)


def tokenised(rows: DataFrame) -> DataFrame:
    """(id, text) -> (row, id, words): hashes of the words of each row; `row` numbers the rows of this table."""

    @giving_back
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in parts:
            for words in words_of(*utf8(part.column(1)), between=SPACE_AND_MARKS):
                lists = pa.ListArray.from_arrays(pa.array(words.bounds().astype(np.int32)), pa.array(words.hash.view(np.int64)))
                ids = part.column(0).slice(words.first_row, words.rows)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(words.rows)), ids, lists], ["row", "id", "words"])
                row += words.rows

    return rows.mapInArrow(batches, f"row bigint, id {dict(rows.dtypes)['id']}, words array<bigint>")


def filter_bits(seeds: DataFrame) -> np.ndarray:
    """A filter with two bits per seed, packed. FILTER_BITS / 64 longs at most come to the driver."""

    @giving_back
    def bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"bit": np.concatenate(places(part["seed"].to_numpy(np.int64)))})

    found = seeds.select("seed").mapInPandas(bits, "bit bigint")
    longs = found.groupBy((F.col("bit") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in longs.toLocalIterator():
        table[r["at"]] = r["bits"]
    return table.view(np.uint8)


def places(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = mix(seed.view(U64) + U64(0x51ED27))
    return seed & (FILTER_BITS - 1), (other & U64(FILTER_BITS - 1)).astype(np.int64)


def candidates(rows: DataFrame, packed: np.ndarray, lengths: list[int]) -> DataFrame:
    """Documents with a run that may be a seed: (row, id, words, seeds)."""

    @giving_back
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in parts:
            for words in words_of(*utf8(part.column(1)), between=SPACE_AND_MARKS):
                hits, of = [], []
                for length in lengths:
                    runs = seeds_of(words.hash, length)
                    one, two = places(runs)
                    at = np.flatnonzero(bits_at(packed, one) & bits_at(packed, two))
                    at = at[words.row[at] == words.row[at + length - 1]]
                    hits.append(runs[at])
                    of.append(words.row[at])
                pair = np.unique(np.stack([np.concatenate(of), np.concatenate(hits)]), axis=1) if hits else np.empty((2, 0), np.int64)
                chosen = np.unique(pair[0])
                if len(chosen):
                    bounds = words.bounds()
                    lists = [words.hash[bounds[k] : bounds[k + 1]].view(np.int64) for k in chosen]
                    seeds = np.split(pair[1], np.searchsorted(pair[0], chosen[1:]))
                    ids = part.column(0).take(pa.array(chosen + words.first_row))
                    of_list = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row + chosen), ids, pa.array(lists, of_list), pa.array(seeds, of_list)], ["row", "id", "words", "seeds"]
                    )
                row += words.rows

    return rows.mapInArrow(batches, f"row bigint, id {dict(rows.dtypes)['id']}, words array<bigint>, seeds array<bigint>")


def room(free: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many free words follow each other from each word on, itself included; words apart in `place` are no run."""
    last = np.append((np.diff(place) != 1) | ~free[1:], True) if len(free) else free
    ends = np.flatnonzero(last)
    return np.where(free, ends[np.searchsorted(ends, np.arange(len(free)))] + 1 - np.arange(len(free)), 0)


def tiles(text: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in text, place in item, length), longest first, ties by place in the text, then the item.

    The longest length at which unmarked runs of both sides have a common hash is searched by halves, as a match
    holds matches of all shorter lengths; all its matches are marked, and the search goes on below. Memory follows
    the words of both sides, not the pairs of equal places, however often words repeat.
    """
    own, other = seeds_of(text, shortest), np.unique(seeds_of(item, shortest))
    covered = np.zeros(len(text) + 1, np.int64)
    hits = np.flatnonzero(np.isin(own, other))
    covered[hits] += 1
    covered[hits + shortest] -= 1
    place = np.flatnonzero(np.cumsum(covered[:-1]) > 0)  # no match reaches beyond these words
    words, everywhere = text[place], np.arange(len(item))
    free_text, free_item, found = np.ones(len(words), bool), np.ones(len(item), bool), []

    def common(length: int) -> tuple[np.ndarray, ...]:
        """Places and hashes of unmarked runs of this length that both sides have, in order of places."""
        sides = []
        for side, run in ((words, run_text), (item, run_item)):
            starts = np.flatnonzero(run >= length)
            sides.append((starts, rolling(side, length)[starts]))
        (i, one), (j, two) = sides
        here, there = np.isin(one, two), np.isin(two, one)
        return i[here], one[here], j[there], two[there]

    longest = min(len(words), len(item))
    while longest >= shortest:
        run_text, run_item = room(free_text, place), room(free_item, everywhere)
        longest = min(longest, int(run_text.max(initial=0)), int(run_item.max(initial=0)))
        low, high = shortest - 1, longest  # a match of `low` words exists, or low is too short to matter
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < shortest:
            break
        i, one, j, two = common(low)
        spots: dict[int, list[int]] = {}
        for b, key in zip(j[::-1].tolist(), two[::-1].tolist(), strict=True):
            spots.setdefault(key, []).append(b)  # the earliest is last
        past = 0
        for a, key in zip(i.tolist(), one.tolist(), strict=True):
            left = spots[key]
            while a >= past and left:
                b = left.pop()
                if free_item[b : b + low].all():
                    free_text[a : a + low] = free_item[b : b + low] = False
                    found.append((int(place[a]), b, low))
                    past = a + low
        longest = low - 1
    return found


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", coverage: float = COVERAGE,
) -> DataFrame:
    """Pairs of a document and an item that it leaks: id, text_hash, item, coverage, n_tiles, spans.

    `spans` are the document's tiles as [first, past) word places. A null text, and an item without words, leak
    nothing. An item of fewer than SEED words leaks where the document has all of it in a row. Rows that repeat are
    judged each; other columns are not read. A coverage equal to the threshold is a leak. Empty tables give no rows.
    """
    text = F.lower(F.col(f"`{item_text_column}`"))
    items = stored(tokenised(benchmark.select(F.col(f"`{item_column}`").alias("id"), text.alias("text"))).filter("size(words) > 0"), "items")

    @giving_back
    def seeded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row, words in zip(part["row"], part["words"], strict=True):
                length = min(SEED, len(words))
                found, times = np.unique(seeds_of(np.asarray(words, np.int64).view(U64), length), return_counts=True)
                yield pd.DataFrame({"item_row": row, "length": length, "seed": found, "share": times * length / len(words)})

    seeds = stored(items.mapInPandas(seeded, "item_row bigint, length int, seed bigint, share double"), "seeds")
    lengths = sorted(r[0] for r in seeds.select("length").distinct().collect())  # SEED values at most
    packed = filter_bits(seeds)
    body = F.col(f"`{text_column}`")
    rows = docs.select(F.struct(F.col(f"`{id_column}`").alias("id"), F.xxhash64(body).alias("hash")).alias("id"), F.lower(body).alias("text"))
    met = stored(candidates(rows, packed, lengths), "candidates")
    # Tiles cover no word outside common seeds, so pairs whose seeds together are too short for a leak need no tiling.
    shared = met.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("row", "item_row").agg(F.sum("share").alias("most"))
    pairs = shared.filter(F.col("most") >= coverage * (1 - 1e-9)).select("row", "item_row")
    whole = items.select(F.col("row").alias("item_row"), F.col("id").alias("item"), F.col("words").alias("item_words"))
    both = pairs.join(met.select("row", "id", "words"), "row").join(whole, "item_row")

    @giving_back
    def tiled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for words, item in zip(part["words"], part["item_words"], strict=True):
                words, item = (np.asarray(x, np.int64).view(U64) for x in (words, item))
                found = tiles(words, item, min(SEED, len(item)))
                out.append((sum(n for _, _, n in found) / len(item), len(found), sorted([a, a + n] for a, _, n in found)))
            got = pd.DataFrame(out, columns=["coverage", "n_tiles", "spans"])
            got.insert(0, "item", part["item"].to_numpy())
            got.insert(0, "row", part["row"].to_numpy())
            yield got[got["coverage"] >= coverage]

    kind = dict(whole.dtypes)["item"]
    slim = both.select("row", "item", "words", "item_words")
    found = slim.mapInPandas(tiled, f"row bigint, item {kind}, coverage double, n_tiles bigint, spans array<array<bigint>>")
    named = found.join(met.select("row", "id"), "row")
    return named.select(F.col("id.id").alias(id_column), F.col("id.hash").alias("text_hash"), F.col("item").alias(item_column), "coverage", "n_tiles", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    bad = leaks(docs, benchmark, id_column, text_column).select(F.col(id_column).alias("of"), F.col("text_hash").alias("of_hash")).distinct()
    bad = stored(bad, "leaking")
    rows = boxed(docs, id=named(id_column), hash=F.xxhash64(named(text_column)))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left_anti").select("doc.*")
