"""The best documents for each item by lexical impact, from K2-treaps over blocks of the term-document grid.

A block holds the cells (term, document) of some thousand documents. Its grid is cut into four, and four again; a node
knows which of its quarters hold cells, and the largest impact below it. The terms of an item are rows: each has a path
of nodes over a range of documents, and the sum over its rows of weight times largest impact bounds the score of every
document in the range. Ranges are halved best first, all rows of the item at once, until no bound reaches the item's
tenth score. Blocks are made and searched in the task that reads the texts; what is shuffled is ten rows per item and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sqlcurate.llm.lookup import Lookup
from sqlcurate.llm.rows import named
from sqlcurate.llm.words import SPACE_AND_MARKS, U64, utf8, words_of
from sqlcurate.sources.storage import stored

#: Distinct terms, added up over items, that one pass over the documents serves; more items take more passes.
PASS_TERMS = 1 << 16
#: A block is closed when it has so many documents, or so many cells.
BLOCK_DOCUMENTS, BLOCK_CELLS = 1 << 13, 1 << 20
#: Range-row pairs looked at in one step of a search.
STEP = 1 << 13
#: Parts in which a term's rows of results are first ranked.
SPREAD = 64

#: Quarters that a node has before quarter q, by the node's four bits.
BEFORE = np.array([[bin(bits & (1 << q) - 1).count("1") for q in range(4)] for bits in range(16)], np.int32)


def interleaved(row: np.ndarray, column: np.ndarray, height: int) -> np.ndarray:
    """Row and column numbers bit by bit, a row's bit before the column's."""
    code = np.zeros(len(row), np.int64)
    for bit in range(height):
        code |= (row >> bit & 1) << 2 * bit + 1 | (column >> bit & 1) << 2 * bit
    return code


class K2Treap:
    """Cells of a square grid of 2^height rows; node 0 stands for a quarter without cells, node 1 is the root.

    Nodes lie level by level in the order of their quarters, so four bits and the place of its first child lead from a
    node to all children.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, height: int):
        self.height = height
        code = interleaved(rows.astype(np.int64), columns.astype(np.int64), height)
        order = np.argsort(code, kind="stable")
        code, impact = code[order], impacts[order].astype(np.int32)
        levels = [(np.zeros(len(code), np.uint8), impact)]  # from the cells up
        for _ in range(height):
            above = code >> 2
            first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(code) else np.empty(0, np.int64)
            bits = np.bitwise_or.reduceat(1 << (code & 3), first).astype(np.uint8) if len(code) else np.empty(0, np.uint8)
            impact = np.maximum.reduceat(impact, first) if len(code) else impact
            levels.append((bits, impact))
            code = above[first]
        levels.reverse()
        self.bits = np.concatenate([np.zeros(1, np.uint8), *[bits for bits, _ in levels]])
        self.top = np.concatenate([np.zeros(1, np.int32), *[impact for _, impact in levels]])
        children = np.bitwise_count(self.bits).astype(np.int32)
        self.first = np.cumsum(children, dtype=np.int32) - children + 2  # children follow in the order of their parents
        self.some = len(levels[0][0]) > 0

    def child(self, nodes: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        bits = self.bits[nodes]
        return (self.first[nodes] + BEFORE[bits, quarter]) * (bits >> quarter & 1)

    def search(self, rows: np.ndarray, weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores that may be among the best `k` and reach `least`; scores are sums over `rows`."""
        found_column, found_score = np.empty(0, np.int64), np.empty(0, np.int64)
        if not self.some:
            return found_column, found_score
        at_once = max(1, STEP // max(1, len(rows)))
        row_bits = (rows[None, :] >> np.arange(self.height)[::-1, None] & 1) * 2  # a level's bit of each row
        nodes, prefix, level = np.ones((1, len(rows)), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int((self.top[1] * weights).sum())])
        if not self.height:
            row_bits = np.zeros((1, len(rows)), np.int64)
        least = max(least, 1)
        while len(bound):
            if len(bound) > at_once:
                best = np.argpartition(-bound, at_once)
                take, rest = best[:at_once], best[at_once:]
            else:
                take, rest = np.arange(len(bound)), np.empty(0, np.int64)
            held = nodes[rest], prefix[rest], level[rest], bound[rest]
            mine, columns, depth, ends = nodes[take], prefix[take], level[take], bound[take]
            ready = depth == self.height  # single documents, whose bound is their score
            if ready.any():
                found_column, found_score = np.concatenate([found_column, columns[ready]]), np.concatenate([found_score, ends[ready]])
                if len(found_score) >= k:
                    least = max(least, int(np.partition(found_score, len(found_score) - k)[len(found_score) - k]))
                    found_column, found_score = found_column[found_score >= least], found_score[found_score >= least]
                mine, columns, depth = mine[~ready], columns[~ready], depth[~ready]
            parts = [held]
            if len(depth):
                bits = row_bits[depth]
                for half in (0, 1):
                    child = self.child(mine, bits + half)
                    parts.append((child, columns * 2 + half, depth + 1, (self.top[child] * weights).sum(axis=1)))
            nodes, prefix, level, bound = (np.concatenate(column) for column in zip(*parts, strict=True))
            on = bound >= least
            nodes, prefix, level, bound = nodes[on], prefix[on], level[on], bound[on]
        return found_column, found_score


@dataclass
class Items:
    """Items of one pass, and the terms that they have, in ascending order of document frequency."""

    numbers: list[int]
    ids: list
    rows: list[np.ndarray]
    terms: np.ndarray
    weights: np.ndarray
    documents: int
    total: int


def passes(items: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list[int], list, list[np.ndarray]]]:
    """Numbers, ids and distinct terms of items, as many at a time as one pass serves; the driver holds no more."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            terms = [b""] * part.num_rows
            for block in words_of(*utf8(part.column(1)), between=SPACE_AND_MARKS):
                bounds = block.bounds()
                for row in range(block.rows):
                    terms[block.first_row + row] = np.unique(block.hash[bounds[row] : bounds[row + 1]]).tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.binary())], ["id", "terms"])

    kind = items.schema[id_column].dataType.simpleString()
    asked = items.select(named(id_column).alias("id"), named(text_column).cast("string").alias("text")).mapInArrow(batches, f"id {kind}, terms binary")
    numbers, ids, terms, size = [], [], [], 0
    for number, row in enumerate(asked.filter(F.length("terms") > 0).toLocalIterator()):
        own = np.frombuffer(row["terms"], U64)
        if numbers and size + len(own) > PASS_TERMS:
            yield numbers, ids, terms
            numbers, ids, terms, size = [], [], [], 0
        numbers.append(number)
        ids.append(row["id"])
        terms.append(own)
        size += len(own)
    if numbers:
        yield numbers, ids, terms


def frequencies(docs: DataFrame, text_column: str, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents with repeats, and the documents that hold each of `terms`."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, found = Lookup(shared.value), np.zeros(len(shared.value), np.int64)
        documents = total = 0
        for part in parts:
            for block in words_of(*utf8(part.column(0)), between=SPACE_AND_MARKS):
                documents += int((block.counts() > 0).sum())
                total += len(block.hash)
                term = lookup.find(block.hash).astype(np.int64)
                seen = np.unique(block.row[term >= 0].astype(np.int64) * len(found) + term[term >= 0])
                found += np.bincount(seen % len(found), minlength=len(found))
        some = np.flatnonzero(found)
        columns = [np.concatenate([[-1, -2], some]), np.concatenate([[documents, total], found[some]])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "n"])

    counted = docs.select(named(text_column).cast("string").alias("text")).mapInArrow(batches, "slot bigint, n bigint")
    sums = dict(counted.groupBy("slot").agg(F.sum("n").alias("n")).collect())
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(t, 0) for t in range(len(terms))], np.int64)


class Search:
    """Texts of a task, block by block, and the best documents of each item so far."""

    def __init__(self, items: Items, k: int, length_share: int):
        self.items, self.k, self.share = items, k, length_share
        self.lookup = Lookup(items.terms)
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in items.ids]  # (-score, no id, id)
        self._open()

    def _open(self) -> None:
        self.cells, self.doc_ids, self.sizes, self.n_cells = [], [], [], 0

    def add(self, texts: pa.Array, doc_ids: pa.Array) -> None:
        width = len(self.items.terms)
        for block in words_of(*utf8(texts), between=SPACE_AND_MARKS):
            term = self.lookup.find(block.hash).astype(np.int64)
            at = np.flatnonzero(term >= 0)
            cell, times = np.unique(block.row[at].astype(np.int64) * width + term[at], return_counts=True)
            row, before = cell // width, sum(map(len, self.sizes))
            self.cells.append((row + before, cell % width, times))
            self.sizes.append(block.counts())
            self.doc_ids += doc_ids[block.first_row : block.first_row + block.rows].to_pylist()
            self.n_cells += len(cell)
            if len(self.doc_ids) >= BLOCK_DOCUMENTS or self.n_cells >= BLOCK_CELLS:
                self.close()

    def close(self) -> None:
        """Make the treap of the block and search it for every item."""
        if self.n_cells:
            items = self.items
            column, row, times = (np.concatenate(parts) for parts in zip(*self.cells, strict=True))
            m = 100 - self.share + self.share * np.concatenate(self.sizes) * items.documents // items.total
            impact = 1_000_000_000 * times // (1000 * times + 8 * m[column])
            height = max(len(items.terms) - 1, len(self.doc_ids) - 1).bit_length()
            treap = K2Treap(row, column, impact, height)
            for number, rows in enumerate(items.rows):
                best = self.best[number]
                least = -best[-1][0] if len(best) == self.k else 1
                columns, scores = treap.search(rows, items.weights[rows], least, self.k)
                if len(columns):
                    ids = (self.doc_ids[c] for c in columns.tolist())
                    best += [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids, strict=True)]
                    best.sort()
                    del best[self.k :]
        self._open()


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, length_share: int = 90, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of every item, of those with a score above 0.

    Terms are runs of letters, digits and non-ASCII, A-Z lower-cased. A term weighs floor(1000 ln((2N+2) / (2df+1)));
    a document scores the sum of weight * (10^9 tf div (1000 tf + 8 m)) over the item's distinct terms, where m is
    100 - length_share + length_share * n * N div L. Equal scores are ranked by ascending doc_id, an integer; null ids
    come last, rows that repeat are ranked each. An item without terms has no rows, items that repeat have theirs each.
    Null texts have no terms; empty tables give no rows. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    item_kind = items.schema[item_column].dataType
    arrow_kind, schema = to_arrow_type(item_kind), f"number bigint, part bigint, item_id {item_kind.simpleString()}, doc_id bigint, score bigint"
    asked = docs.select(named(text_column).cast("string").alias("text"), named(id_column).cast("long").alias("doc_id"))
    found = None
    for numbers, ids, terms in passes(items, item_column, item_text):
        distinct = np.unique(np.concatenate(terms))
        documents, total, df = frequencies(docs, text_column, distinct)
        if not total:
            break
        order = np.argsort(df, kind="stable")  # neighbours in the grid are about as frequent
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df[order].tolist()], np.int64)
        row_of = np.empty(len(order), np.int64)
        row_of[order] = np.arange(len(order))
        rows = [row_of[np.searchsorted(distinct, own)] for own in terms]
        shared = spark.sparkContext.broadcast(astuple(Items(numbers, ids, rows, distinct[order], weights, documents, total)))

        def batches(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(items := Items(*shared.value), k, length_share)
            for part in parts:
                search.add(part.column(0), part.column(1))
            search.close()
            part_number = TaskContext.get().partitionId() % SPREAD
            out = [(items.numbers[i], part_number, items.ids[i], None if no_id else doc_id, -score)
                   for i, best in enumerate(search.best) for score, no_id, doc_id in best]
            kinds = [pa.int64(), pa.int64(), arrow_kind, pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["number", "part", "item_id", "doc_id", "score"])

        own = stored(asked.mapInArrow(batches, schema), "search")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    in_part = F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    best = found.withColumn("at", in_part).filter(F.col("at") <= k).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
