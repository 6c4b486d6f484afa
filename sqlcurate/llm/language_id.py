"""Language of whole texts by a string kernel.

Kernel: presence of byte n-grams of all lengths in LENGTHS (blended spectrum), the size of the intersection over
the root of both sizes. Nyström landmarks turn it into a feature map; one ridge regression per language learns on
it, one language against the rest. Texts are scored in blocks by two matrix products.

n-grams are hashed to CELLS values; A-Z are lower-cased, digits and white space count as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sqlcurate.llm.words import LOWER, utf8

LENGTHS, CELLS = (1, 2, 3), 1 << 16
#: Bounds of what the classifier is fitted on: texts of each language, of at most so many bytes, and landmarks.
TRAIN_TEXTS, TRAIN_BYTES, LANDMARKS, RIDGE = 500, 1 << 16, 32, 1e-4
BLOCK = 1 << 20

FOLD = LOWER.copy()
FOLD[[*range(0x09, 0x0E), *range(0x30, 0x3A)]] = 0x20


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row x cell: whether the row's text has an n-gram of that hash."""
    own = offsets - offsets[0]
    code = FOLD[data[offsets[0] : offsets[-1]]].astype(np.uint32)
    rows = len(own) - 1
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(own))
    seen = np.zeros(rows * CELLS, bool)
    gram = np.zeros(len(code), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        gram = (gram[: len(code) - n + 1] << np.uint32(8)) | code[n - 1 :]
        if n in LENGTHS and len(gram):
            inside = row[: len(gram)] == row[n - 1 :]
            cell = (((gram + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - 16)).astype(np.int64)
            seen[(row[: len(gram)] * CELLS + cell)[inside]] = True
    return seen.reshape(rows, CELLS)


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row and presence of rows of about BLOCK bytes, 512 at most; a longer text is one block."""
    first, last = 0, len(offsets) - 1
    while first < last:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        stop = min(stop, first + 512, last)
        yield first, presence(data, offsets[first : stop + 1])
        first = stop


@dataclass
class Classifier:
    languages: list[str]
    cells: np.ndarray  # that some landmark has
    marks: np.ndarray  # cell x landmark, over the root of the landmark's size
    weights: np.ndarray  # landmark x language; the map through the landmarks' kernel is folded in
    bias: np.ndarray

    def decisions(self, seen: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(seen.sum(1), 1))[:, None]
        return (seen[:, self.cells].astype(np.float32) @ self.marks / size) @ self.weights + self.bias


def fit(texts: list[str], languages: list[str]) -> Classifier | None:
    """None without texts. Texts come in a fixed order; the first of each language are its landmarks."""
    if not texts:
        return None
    names = sorted(set(languages))
    seen = np.concatenate([x for _, x in blocks(*utf8(pa.array(texts, pa.string())))])
    label = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(label == k)[:LANDMARKS] for k in range(len(names))])
    cells = np.flatnonzero(seen[chosen].any(0))
    marks = (seen[chosen][:, cells] / np.sqrt(np.maximum(seen[chosen].sum(1), 1))[:, None]).T.astype(np.float32)
    kernel = (seen[:, cells].astype(np.float32) @ marks / np.sqrt(np.maximum(seen.sum(1), 1))[:, None]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[chosen])
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6 * value.max()))) @ vector.T
    mapped = kernel @ root
    target = (label[:, None] == np.arange(len(names))).astype(float)
    share = np.bincount(label, minlength=len(names)).astype(float)
    weight = (1 / share)[label][:, None] * len(label) / len(names)  # every language counts the same
    mean, middle = (weight * target).sum(0) / weight.sum(), (weight * mapped).sum(0) / weight.sum()
    centred = mapped - middle
    ridge = centred.T @ (weight * centred) + RIDGE * len(label) * np.eye(len(chosen))
    weights = np.linalg.solve(ridge, centred.T @ (weight * (target - mean)))
    return Classifier(names, cells, marks, (root @ weights).astype(np.float32), (mean - middle @ weights).astype(np.float32))


def training_texts(docs: DataFrame, text_column: str, language_column: str, eligible: Column, key: Column) -> DataFrame:
    """TRAIN_TEXTS rows of each language in hash order: language, text. Bounded by the number of languages.

    Rows are chosen without their texts, and only the chosen ids are looked up; an id that repeats teaches once.
    """
    text = F.col(f"`{text_column}`")
    able = docs.filter(eligible & key.isNotNull() & text.rlike(r"\p{L}") & (F.octet_length(text) <= TRAIN_BYTES))
    rows = able.select(key.alias("id"), F.col(f"`{language_column}`").alias("language"), text.alias("text")).filter("language IS NOT NULL")
    place = Window.partitionBy("language").orderBy(F.xxhash64("id", F.lit(8)), "id")
    ranked = rows.select("id", "language").withColumn("n", F.row_number().over(place)).filter(F.col("n") <= TRAIN_TEXTS)
    chosen = ranked.groupBy("id").agg(F.min("n").alias("n"))
    found = rows.join(F.broadcast(chosen), "id").groupBy("id", "n").agg(F.min(F.struct("language", "text")).alias("row"))
    return found.orderBy("row.language", "n", "id").select("row.language", "row.text")


def identify(
    docs: DataFrame, eligible: Column, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang"
) -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1: the winning regression's value, clipped).

    Only rows that are `eligible` and have an id, a language and a letter teach. A text that is null or has no letter is
    `und` with score 0, and so is every text if no row teaches. Equal values go to the first language by name.
    Rows that repeat are predicted each; further columns are not read. An empty table gives an empty result.
    """
    taught = training_texts(docs, text_column, language_column, eligible, F.col(f"`{id_column}`")).collect()
    model = fit([r["text"] for r in taught], [r["language"] for r in taught])
    names = [id_column, "lang_pred", "score"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
            if model:
                for first, seen in blocks(*utf8(part.column(1))):
                    values = model.decisions(seen)
                    best[first : first + len(seen)] = values.argmax(1)
                    score[first : first + len(seen)] = np.clip(values.max(1), 0, 1)
            told = np.asarray(part.column(2)) & (best >= 0)
            language = pa.array([model.languages[k] if ok else "und" for k, ok in zip(best, told, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), language, pa.array(np.where(told, score, 0.0))], names)

    text = F.col(f"`{text_column}`")
    rows = docs.select(F.col(f"`{id_column}`"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(batches, f"`{id_column}` {dict(docs.dtypes)[id_column]}, lang_pred string, score double")
