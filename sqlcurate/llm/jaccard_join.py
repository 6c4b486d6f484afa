"""Grouped prefix join of documents by the Jaccard similarity of their word shingles; links as components.

Two sets with similarity t share a shingle among the first n - ceil(t n) + 1 of each, if all sets are ordered alike.
Rare shingles come first; rarity is a count per cell of a hash, made over all documents. Equal sets are one class,
and classes of equal size and prefix one group. Then, in lists of the groups that have a prefix shingle in common:

1. the most central group of a list (that with the fewest rarer shingles before it) meets all others, and the
   classes of a group meet one of them; these pairs are verified on the whole sets and linked;
2. what a list still holds of different components is compared class by class within blocks of bounded size, by
   size, place and counts of shingle classes; pairs that survive are verified too.

So no list is expanded into all its pairs, and no link is lost. Cells are a parameter: with more distinct shingles
than cells more pairs have to be verified, and results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcurate.llm.components import components
from sqlcurate.llm.lookup import bits_at
from sqlcurate.llm.words import U64, Words, chain, mix, rolling, utf8, words_of
from sqlcurate.llm.workers import giving_back, stored

#: Cells of the shingle counts and the parts in which they travel. A count is kept up to 255, and broadcast as its
#: level: 0 for one or none, 1 for 2, 2 for 3 and 4, then up to 8, 16, ...; compressed, CELLS bytes at most.
CELLS, PARTS = 1 << 26, 512
LEVEL = np.ceil(np.log2(np.maximum(np.arange(256), 1))).astype(np.uint8)
#: Classes by which shingles of a set are counted (in two bytes each, or four where one holds more), entries of a list that a block compares, bits of the set filter.
KINDS, BLOCK_ENTRIES, FILTER_BITS = 64, 2048, 1 << 25


def shingle_sets(words: Words, length: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row; fewer words than `length` make one shingle, none make none."""
    runs, bounds = rolling(words.hash, length), words.bounds()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= length:
            yield np.unique(runs[low : high - length + 1])
        elif high > low:
            yield rolling(words.hash[low:high], high - low)
        else:
            yield np.empty(0, U64)


def signature(shingles: np.ndarray) -> int:
    """One hash of a whole set."""
    if not len(shingles):
        return 0
    return int(chain(np.array([shingles.sum()]), np.array([mix(shingles + U64(7)).sum()]), np.array([len(shingles)], U64)).view(np.int64)[0])


def rows_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))


def cell_levels(rows: DataFrame, length: int) -> bytes:
    """How many rows have a shingle of each cell, as compressed levels. They come to the driver in PARTS parts."""
    width = CELLS // PARTS

    @giving_back
    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint8)
        for part in parts:
            for words in words_of(*utf8(part.column(0))):
                sets = list(shingle_sets(words, length))
                cell, n = np.unique(np.concatenate(sets) & U64(CELLS - 1), return_counts=True)
                counts[cell] = np.minimum(counts[cell].astype(np.int64) + n, 255)
        codec = pa.Codec("zstd")
        for k in range(PARTS):
            block = counts[k * width : (k + 1) * width]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([codec.compress(block.tobytes(), asbytes=True)])], ["part", "counts"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for packed in group["counts"]:
            total += np.frombuffer(pa.Codec("zstd").decompress(packed, width, asbytes=True), np.uint8)
        packed = pa.Codec("zstd").compress(np.minimum(total, 255).astype(np.uint8).tobytes(), asbytes=True)
        return pd.DataFrame({"part": group["part"].iloc[:1], "counts": [packed]})

    summed = rows.select("text").mapInArrow(counted, "part int, counts binary").groupBy("part").applyInPandas(added, "part int, counts binary")
    out = np.zeros(CELLS, np.uint8)
    for r in stored(summed, "cells").toLocalIterator():
        counts = np.frombuffer(pa.Codec("zstd").decompress(bytes(r["counts"]), width, asbytes=True), np.uint8)
        out[r["part"] * width : (r["part"] + 1) * width] = LEVEL[counts]
    return pa.Codec("zstd").compress(out, asbytes=True)


def prefixes(spark: SparkSession, rows: DataFrame, length: int, num: int, den: int) -> DataFrame:
    """Per row: id, size, set (signature), tokens and places of prefix shingles that another row may have, kinds."""
    shared = spark.sparkContext.broadcast(cell_levels(rows, length))
    longs = pa.list_(pa.int64())

    @giving_back
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(pa.Codec("zstd").decompress(shared.value, CELLS, asbytes=True), np.uint8)
        for part in parts:
            for words in words_of(*utf8(part.column(1))):
                size, sign, token, place, kinds = [], [], [], [], []
                for shingles in shingle_sets(words, length):
                    n = len(shingles)
                    rarity = levels[shingles & U64(CELLS - 1)]
                    order = np.argsort(rarity, kind="stable")  # equally rare ones stay in the order of their hashes
                    first = np.arange(n - -(-num * n // den) + 1) if n else np.empty(0, np.int64)
                    first = first[rarity[order[first]] > 0]  # a shingle counted once is nowhere else
                    size.append(n)
                    sign.append(signature(shingles))
                    token.append(shingles[order[first]].view(np.int64))
                    place.append(first)
                    counts = np.bincount((shingles[rarity > 0] >> U64(40)) & U64(KINDS - 1), minlength=KINDS)
                    kinds.append(counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes() if len(first) else b"")
                ids = part.column(0).slice(words.first_row, words.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size, pa.int64()), pa.array(sign, pa.int64()), pa.array(token, longs), pa.array(place, longs), pa.array(kinds)],
                    ["id", "size", "set", "token", "place", "kinds"],
                )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(batches, f"id {kind}, size bigint, set bigint, token array<bigint>, place array<bigint>, kinds binary")


def set_filter(sets: DataFrame) -> np.ndarray:
    """Packed bits of the chosen signatures: FILTER_BITS at most come to the driver."""
    at = F.col("set").bitwiseAND(FILTER_BITS - 1)
    longs = sets.groupBy(F.shiftright(at, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(set & 63 AS int)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in longs.toLocalIterator():
        table[r["at"]] = r["bits"]
    return table.view(np.uint8)


def whole_sets(rows: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(set, shingles) of the chosen signatures, from the texts; the filter lets a few more through."""
    bits = set_filter(chosen)

    @giving_back
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for words in words_of(*utf8(part.column(0))):
                sets = list(shingle_sets(words, length))
                signs = [signature(shingles) for shingles in sets]
                known = bits_at(bits, np.array(signs, np.int64) & (FILTER_BITS - 1))
                found = {sign: shingles.view(np.int64) for sign, shingles, hit in zip(signs, sets, known, strict=True) if hit}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["set", "shingles"])

    made = rows.select("text").mapInArrow(batches, "set bigint, shingles array<bigint>")
    return made.groupBy("set").agg(F.any_value("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets whose similarity reaches num/den, on all their shingles."""
    left, right = (sets.select(F.col("set").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")

    @giving_back
    def checked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keep = []
            for x, y in zip(part["of_a"], part["of_b"], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield part.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(checked, "a bigint, b bigint")


def possible(num: int, den: int) -> str:
    """Whether sizes and places (x.., y..) leave room for the similarity, seen from the first shingle in common."""
    room = "(1 + least(x_size - x_place, y_size - y_place) - 1)"
    return f"{den} * least(x_size, y_size) >= {num} * greatest(x_size, y_size) AND {room} * {den + num} >= {num} * (x_size + y_size)"


def left_over(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components in a list that sizes, places and kinds leave possible.

    entries: token, set, size, place, kinds, root. A list is dealt to blocks: each entry goes to every block that
    compares its chunk with another, so a task compares BLOCK_ENTRIES entries with as many at most.
    """
    lists = entries.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    chunks = F.ceil(F.col("n") / BLOCK_ENTRIES).cast("int")
    dealt = entries.join(lists.select("token", chunks.alias("chunks")), "token").withColumn("chunk", F.pmod(F.hash("set"), "chunks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    placed = dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")

    def pairs(part: pd.DataFrame) -> np.ndarray:
        """Both signatures of each surviving pair of one block."""
        size, place = part["size"].to_numpy(), part["place"].to_numpy()
        alive = (size - place) * (den + num) >= num * (size + -(-num * size // den))
        part = part[alive]
        if part["root"].nunique() < 2:
            return np.empty((0, 2), np.int64)
        size, place, root, sign, chunk = (part[c].to_numpy() for c in ("size", "place", "root", "set", "chunk"))
        kinds = np.stack([np.frombuffer(k, np.uint16 if len(k) == 2 * KINDS else np.uint32) for k in part["kinds"]]).astype(np.int64)
        low, high = part["low"].iloc[0], part["high"].iloc[0]
        out = []
        for i in np.flatnonzero(chunk == low):
            j = np.flatnonzero((chunk == high) & (root != root[i]) & ((sign > sign[i]) | (low != high)))
            small, large = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
            need = -(-num * (size[j] + size[i]) // (den + num))
            j = j[(den * small >= num * large) & (np.minimum(size[j] - place[j], size[i] - place[i]) >= need)]
            need = -(-num * (size[j] + size[i]) // (den + num))
            j = j[np.minimum(kinds[j], kinds[i]).sum(1) >= need]
            out.append(np.stack([np.full(len(j), sign[i]), sign[j]], 1))
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)

    @giving_back
    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        keys = ["token", "low", "high"]
        for part in parts:
            held = part if held is None else pd.concat([held, part])
            change = np.flatnonzero((held[keys].to_numpy()[1:] != held[keys].to_numpy()[:-1]).any(1)) + 1
            cuts = [0, *change.tolist()]
            found = [pairs(held.iloc[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            held = held.iloc[cuts[-1] :]
            if found and len(got := np.concatenate(found)):
                yield pd.DataFrame(got, columns=["a", "b"])
        if held is not None and len(got := pairs(held)):
            yield pd.DataFrame(got, columns=["a", "b"])

    found = placed.select("token", "low", "high", "chunk", "set", "size", "place", "kinds", "root").mapInPandas(batches, "a bigint, b bigint")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar(
    docs: DataFrame, length: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row of `docs`: id, n_shingles, set (equal for equal sets), component_id (smallest id that links reach).

    Words are runs outside space and 0x09-0x0D with A-Z in lower case. Rows link if their sets of `length`-word
    shingles have a similarity of `percent` or more, equality included. A row without words links with nothing and
    is its own component. Rows that repeat are linked like any equal sets; null ids are never the smallest. Other
    columns are not read. An empty table gives an empty result.
    """
    spark, num, den = docs.sparkSession, percent, 100
    rows = rows_of(docs, id_column, text_column)
    seen = stored(prefixes(spark, rows, length, num, den), "prefixes")
    classes = seen.filter("size(token) > 0").groupBy("set").agg(*[F.any_value(c).alias(c) for c in ("size", "token", "place", "kinds")])
    classes = classes.withColumn("group", F.xxhash64("size", "token", "place"))
    # Groups: a representative class; the others of a group meet it.
    reps = classes.groupBy("group").agg(F.min("set").alias("rep"), F.any_value("size").alias("size"), F.any_value("token").alias("token"), F.any_value("place").alias("place"))
    listed = reps.select(F.col("rep").alias("set"), "size", F.explode(F.arrays_zip("token", "place")).alias("e")).select("set", "size", "e.token", "e.place")
    listed = stored(listed, "lists")
    hubs = listed.groupBy("token").agg(F.min(F.struct("place", "size", "set")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    met = listed.join(hubs.select("token", "hub"), "token").select(
        F.col("set").alias("a"), F.col("hub.set").alias("b"), F.col("size").alias("x_size"), F.col("place").alias("x_place"),
        F.col("hub.size").alias("y_size"), F.col("hub.place").alias("y_place"),
    ).filter("a <> b").filter(possible(num, den)).select("a", "b")
    within = classes.join(reps.select("group", "rep"), "group").filter("set <> rep").select(F.col("set").alias("a"), F.col("rep").alias("b"))
    pairs = stored(met.union(within).distinct(), "pairs")
    # Lists of one group but several classes matter as well, so the entries are those of all classes.
    entries = classes.select("set", "size", "kinds", F.explode(F.arrays_zip("token", "place")).alias("e")).select("set", "size", "kinds", "e.token", "e.place")
    room = f"(size - place) * {den + num} >= {num} * (size + ceil({num} * size / {den}))"
    live = entries.filter(room).groupBy("token").agg(F.min("set").alias("one"), F.max("set").alias("two")).filter("one <> two").select("token")
    entries = stored(entries.filter(room).join(live, "token"), "entries")
    chosen = entries.select("set").union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = stored(whole_sets(rows, chosen, length), "sets")
    links = stored(verified(pairs, sets, num, den), "links")

    first = components(links)
    rooted = entries.join(first.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    more = stored(verified(left_over(rooted, num, den), sets, num, den), "links")
    final = components(links.union(more)).withColumnRenamed("node", "set")

    named = seen.select("id", "size", "set").join(final, "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = stored(named, "rooted")
    smallest = named.filter("size > 0").groupBy("root").agg(F.min("id").alias("least"))
    told = named.join(smallest, "root", "left")
    component = F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("id"))
    return told.select(F.col("id").alias(id_column), F.col("size").alias("n_shingles"), "set", component.alias("component_id"))
