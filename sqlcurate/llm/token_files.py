"""Token ids of documents in binary files: one array of ids per file, document boundaries in Elias-Fano code.

A file holds whole documents in ascending order of id: a header, the ids side by side, the boundaries, the document
ids, and a line feed that Spark's writer adds. Boundaries and document ids ascend, so both are Elias-Fano coded: the
low bits of each number as they are, the high bits in unary, about 2 + log2(largest / count) bits a number, and a
directory of 32-bit ranks through which any number is found without decoding those before it.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from sqlcurate.llm.rows import named
from sqlcurate.sources.storage import stored

U64 = np.uint64
MAGIC = b"TOKENEF1"
#: Magic, bytes per id, partition, number of the file in it, documents, documents without id, ids, first document id.
HEADER = "<8sIIIQQQq"
#: Count of numbers, the largest, low bits of each.
CODED = "<QQQ"
#: Bits of the unary part per entry of the rank directory.
RANKED = 512
#: A file is closed when it has so many ids; a document is never split.
FILE_IDS = 1 << 22
#: Bytes of text to an id, for the number of tasks only.
BYTES_PER_ID = 4
#: Bytes of text encoded at a time; a longer text goes alone.
AT_ONCE = 1 << 20
#: Pieces handed to the library at a time, and characters of pieces whose ids a worker keeps.
PIECES, HELD = 1 << 14, 1 << 23
#: Letters up to U+00FF, and stops behind them: the letters are one pre-token, the stops another.
CORE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?]*)")
# The parts of a tokenizer's description for which `parts_at_spaces` holds.
SPACES_TO_ONE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
WORDS_WITHOUT_SPACE = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True,
}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def padded(raw: bytes, to: int = 8) -> bytes:
    return raw + bytes(-len(raw) % to)


def elias_fano(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers, coded; the length is a multiple of 8."""
    n = len(values)
    largest = int(values[-1]) if n else 0
    low = max(0, (largest // max(n, 1)).bit_length() - 1)
    bits = np.zeros(-(-((largest >> low) + n + 1) // RANKED) * RANKED, np.uint8)
    bits[(values >> U64(low)).astype(np.int64) + np.arange(n)] = 1
    ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, RANKED).sum(axis=1, dtype=np.int64))]).astype("<u4")
    lows = b""
    if low:
        step, shifts = 1 << 16, np.arange(low, dtype=U64)  # 2^16 numbers end at a byte, whatever their bits
        parts = (((values[at : at + step, None] >> shifts) & U64(1)).astype(np.uint8).ravel() for at in range(0, n, step))
        lows = b"".join(np.packbits(part, bitorder="little").tobytes() for part in parts)
    unary = np.packbits(bits, bitorder="little").tobytes()
    return struct.pack(CODED, n, largest, low) + padded(unary) + padded(ranks.tobytes()) + padded(lows + bytes(16))


class EliasFano:
    """Numbers coded by `elias_fano`, read in place from `raw` at byte `at`; `end` is the byte behind them."""

    def __init__(self, raw: bytes | memoryview, at: int = 0):
        self.n, largest, self.low = struct.unpack_from(CODED, raw, at)
        blocks = -(-((largest >> self.low) + self.n + 1) // RANKED)
        at += struct.calcsize(CODED)
        self.unary = np.frombuffer(raw, "<u8", blocks * RANKED // 64, at)
        at += blocks * RANKED // 8
        self.ranks = np.frombuffer(raw, "<u4", blocks + 1, at)
        at += -(-(blocks + 1) * 4 // 8) * 8
        size = -(-(-(-self.n * self.low // 8) + 16) // 8) * 8
        self.lows = np.frombuffer(raw, np.uint8, size, at)
        self.end = at + size

    def __len__(self) -> int:
        return self.n

    def select(self, which: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        which = np.asarray(which, np.int64)
        block = np.searchsorted(self.ranks, which, "right") - 1
        rest, word = which - self.ranks[block], block * (RANKED // 64)
        for _ in range(RANKED // 64 - 1):  # to the word that holds the wanted one
            ones = np.bitwise_count(self.unary[word]).astype(np.int64)
            on = rest >= ones
            rest, word = rest - ones * on, word + on
        left, bit = self.unary[word], np.zeros(len(which), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # to its bit
            ones = np.bitwise_count(left & U64((1 << half) - 1)).astype(np.int64)
            on = rest >= ones
            rest, bit, left = rest - ones * on, bit + half * on, np.where(on, left >> U64(half), left)
        high = (word * 64 + bit - which).astype(U64)
        if not self.low:
            return high
        at = which * self.low
        byte, shift = at >> 3, (at & 7).astype(U64)
        held = np.zeros(len(which), U64)
        for k in range(8):
            held |= self.lows[byte + k].astype(U64) << U64(8 * k)
        more = np.where(shift > U64(0), self.lows[byte + 8].astype(U64) << (U64(64) - np.maximum(shift, U64(1))), U64(0))
        return high << U64(self.low) | (held >> shift | more) & U64((1 << self.low) - 1)


def file_image(ids: list[bytes], doc_ids: list[int | None], width: int, partition: int, number: int) -> bytes:
    """One file. `doc_ids` ascend, those without id come first."""
    ends = np.cumsum([0, *[len(one) // width for one in ids]]).astype(U64)
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    gaps = known.view(U64) - np.array([first], np.int64).view(U64)
    head = struct.pack(HEADER, MAGIC, width, partition, number, len(ids), len(ids) - len(known), int(ends[-1]), first)
    return padded(head) + padded(b"".join(ids)) + elias_fano(ends) + elias_fano(gaps)


class TokenFile:
    """One file in memory; nothing is decoded but what is asked for."""

    def __init__(self, raw: bytes | memoryview):
        magic, width, self.partition, self.number, self.documents, self.without_id, n_ids, self.first = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = -(-struct.calcsize(HEADER) // 8) * 8
        self.ids = np.frombuffer(raw, f"<u{width}", n_ids, at)
        self.bounds = EliasFano(raw, at + -(-n_ids * width // 8) * 8)
        self.doc_gaps = EliasFano(raw, self.bounds.end)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where documents begin and end among the ids of this file."""
        bounds = self.bounds.select(np.arange(self.documents + 1)).astype(np.int64)
        return bounds[:-1], bounds[1:]

    def doc_ids(self) -> list[int | None]:
        gaps = self.doc_gaps.select(np.arange(len(self.doc_gaps)))
        return [None] * self.without_id + (gaps + np.array([self.first], np.int64).view(U64)).view(np.int64).tolist()

    def document(self, place: int) -> np.ndarray:
        start, end = self.bounds.select(np.array([place, place + 1])).astype(np.int64)
        return self.ids[start:end]

    def places(self, doc_id: int) -> range:
        """Where documents with this id stand, by bisection on the coded ids."""

        def before(gap: int) -> int:
            low, high = 0, len(self.doc_gaps)
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if int(self.doc_gaps.select(np.array([middle]))[0]) < gap else (low, middle)
            return low + self.without_id

        return range(before(doc_id - self.first), before(doc_id - self.first + 1)) if doc_id >= self.first else range(0)


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def parts_at_spaces(described: dict) -> bool:
    """Whether ids of a text are those of its pieces between spaces: no pre-token and no added token can hold a space,
    and the normalisers change no character because of one beyond a space."""
    steps = (described["normalizer"] or {}).get("normalizers", [])
    plain = all(step["type"] in ("NFC", "Lowercase") or step == SPACES_TO_ONE for step in steps)
    cut = (described["pre_tokenizer"] or {}).get("pretokenizers", [])
    cut = [{k: v for k, v in step.items() if k != "trim_offsets"} for step in cut]
    added = all(" " not in t["content"] and "\n" not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in described["added_tokens"])
    whole = not (described["truncation"] or described["padding"] or described["post_processor"])
    return plain and added and whole and cut == [WORDS_WITHOUT_SPACE, BYTES] and not described["model"].get("dropout")


class Encoder:
    """Ids of texts as little-endian bytes, `width` to an id, as the library gives them.

    Where texts part at spaces, the ids of pieces are kept and joined, so the library sees each piece once. Of a piece of
    letters with stops behind, the letters go to the library's model in lower case, which is all that its normalisers
    would change, and their bytes in the characters that stand for them there.
    """

    def __init__(self, described: str, end_id: int | None, width: int):
        self.library, self.parts = Tokenizer.from_str(described), parts_at_spaces(json.loads(described))
        self.end, self.kind = [] if end_id is None else [end_id], "H" if width == 2 else "I"
        self.tail, self.model = self.raw(self.end), self.library.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {code: as_bytes.pre_tokenize_str(chr(code))[0][0] for code in range(0xC0, 0x100)}
        self.forget()

    def forget(self) -> None:
        self.pieces, self.words, self.others, self.held = {"": b""}, {}, {"": b""}, 0

    def raw(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [self.raw(found.ids) for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.parts:
            return [ids + self.tail for ids in self.ids_of(texts)]
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        unseen = set().union(*cut).difference(self.pieces)  # "- keys()" would walk all that is kept
        for piece in unseen:
            if found := CORE.fullmatch(piece):
                word, stops = found[1].lower(), found[2]
                if (ids := self.words.get(word)) is None:
                    ids = self.words[word] = self.raw([token.id for token in self.model.tokenize(word if word.isascii() else word.translate(self.shown))])
                self.pieces[piece] = ids + self.other(stops)
        new = [piece for piece in unseen if piece not in self.pieces]
        for at in range(0, len(new), PIECES):
            self.pieces.update(zip(new[at : at + PIECES], self.ids_of(new[at : at + PIECES]), strict=True))
        out = [b"".join(map(self.pieces.__getitem__, pieces)) + self.tail for pieces in cut]
        self.held += sum(map(len, unseen))
        if self.held > HELD:
            self.forget()
        return out

    def other(self, stops: str) -> bytes:
        if stops not in self.others:
            [self.others[stops]] = self.ids_of([stops])
        return self.others[stops]


@lru_cache(1)
def encoder(described: str, end_id: int | None, width: int) -> Encoder:
    """That of the tasks before in the same worker, with the pieces that it keeps."""
    return Encoder(described, end_id, width)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_column: str = "doc_id", text_column: str = "text",
    file_ids: int = FILE_IDS,
) -> None:
    """Write the token ids of whole texts, each followed by `end_id`, in ascending order of document id.

    `tokenizer` is a file of the tokenizers library; special strings in texts are handled as that library does.
    A null text is an empty one. Ids of documents are integers; documents without id come first, rows of one id are
    ordered by a hash of the text. An empty table gives a folder without documents. Other columns are not read.
    Texts are dealt to tasks by ranges of (id, hash, row), so no id and no repeated text is one task's load.
    """
    with open(tokenizer, encoding="utf-8") as file:  # travels with the job, so executors need no copy
        described = file.read()
    width = 2 if max(Tokenizer.from_str(described).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    shared = docs.sparkSession.sparkContext.broadcast(described)
    asked = docs.select(named(id_column).cast("long").alias("doc_id"), F.coalesce(named(text_column).cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("nth")]
    ranges = max(1, math.ceil(size / (BYTES_PER_ID * file_ids)))
    dealt = asked.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def images(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        partition, number, encode = TaskContext.get().partitionId(), 0, None
        blobs, doc_ids, size = [], [], 0
        for part in parts:
            encode = encode or encoder(shared.value, end_id, width)
            ids, lengths = part.column(0), np.cumsum(pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False))
            first = 0
            while first < part.num_rows:
                stop = max(first + 1, int(np.searchsorted(lengths, (lengths[first - 1] if first else 0) + AT_ONCE, "right")))
                for doc_id, blob in zip(ids[first:stop].to_pylist(), encode(part.column(1)[first:stop].to_pylist()), strict=True):
                    blobs.append(blob)
                    doc_ids.append(doc_id)
                    size += len(blob)
                    if size >= file_ids * width:
                        yield pa.RecordBatch.from_arrays([pa.array([file_image(blobs, doc_ids, width, partition, number)], pa.binary())], ["value"])
                        blobs, doc_ids, size, number = [], [], 0, number + 1
                first = stop
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array([file_image(blobs, doc_ids, width, partition, number)], pa.binary())], ["value"])

    written = dealt.select("doc_id", "text").mapInArrow(images, "value binary")
    # Spark's writer for text hands bytes on as they are, to any file system and with its commit of tasks.
    written.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """partition, number, place, doc_id, start, n_tokens, ids_crc32 of all documents; with `ids` the ids too.

    `start` counts the ids before the document in its own file.
    """
    kinds = {"partition": pa.int64(), "number": pa.int64(), "place": pa.int64(), "doc_id": pa.int64(),
             "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    rows_at_once = 1 << 12

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                raw = memoryview(content.as_buffer())
                if not len(raw):
                    continue
                file = TokenFile(raw)
                (starts, ends), doc_ids = file.spans(), file.doc_ids()
                for at in range(0, file.documents, rows_at_once):
                    some = slice(at, min(at + rows_at_once, file.documents))
                    each = [file.ids[a:b] for a, b in zip(starts[some], ends[some], strict=True)]
                    n = len(each)
                    columns = [[file.partition] * n, [file.number] * n, np.arange(at, at + n), doc_ids[some], starts[some],
                               ends[some] - starts[some], [checksum(one) for one in each]]
                    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds.values(), strict=True)]
                    more = [pa.array([one.tolist() for one in each], pa.list_(pa.int32()))] if ids else []
                    yield pa.RecordBatch.from_arrays(arrays + more, [*kinds, *(["ids"] if ids else [])])

    schema = ", ".join(f"{name} bigint" for name in kinds) + (", ids array<int>" if ids else "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(batches, schema)


def with_global_starts(documents: DataFrame) -> DataFrame:
    """`start` counted over all files. One row per file is what the running sum orders, not one per document."""
    documents = stored(documents, "token_rows")
    sizes = documents.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("partition", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    start: Column = F.col("first") + F.col("start")
    return documents.join(firsts, ["partition", "number"]).withColumn("start", start).drop("first")
