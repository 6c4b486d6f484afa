"""Words of whole texts as 64-bit hashes: one pass of numpy over Arrow's UTF-8 buffers, no string per word.

A word is a maximal run of bytes outside space and 0x09-0x0D; A-Z are lower-cased. A word's hash is a
polynomial over its bytes with a random value per byte, taken from prefix sums, then mixed. Equal words
have equal hashes in every process; two of n different words collide with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at a time; a longer text is one block of its own.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
#: Stand for the beginning and the end of a text among hashes of words.
BEGIN, END = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543211)
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, and ASCII that is neither letter nor digit.
SPACE_AND_MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash per row of a sequence of hashes; the order of parts matters."""
    out = mix(parts[0])
    for part in parts[1:]:
        out = mix(out * U64(0x2545F4914F6CDD1D) + part)
    return out


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64))[LOWER]
BYTE_VALUE_CASED = mix(np.arange(1, 257, dtype=U64))
_powers = np.empty(0, U64), np.empty(0, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.concatenate([[U64(1)], np.multiply.accumulate(np.full(n - 1, b & (2**64 - 1), U64))]) for b in (BASE, INVERSE)
            )
    return _powers


@dataclass
class Words:
    """Words of a block of rows: word i is bytes[start[i]:end[i]] of row row[i]; rows are numbered in the block."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bytes: np.ndarray
    first_row: int
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def bounds(self) -> np.ndarray:
        """Word positions at which rows begin, and the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def texts(self, at: np.ndarray) -> list[str]:
        """The chosen words themselves, in lower case as hashed."""
        raw = LOWER[self.bytes].tobytes()
        return [raw[self.start[i] : self.end[i]].decode("utf-8", "replace") for i in at]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_null(column.type) else pa.array([b""] * len(column), pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: np.ndarray = SPACE) -> Iterator[Words]:
    """Blocks of whole rows of about BLOCK bytes each; `between` says which bytes part words."""
    first, last = 0, len(offsets) - 1
    while first < last:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        own = offsets[first : stop + 1] - offsets[first]
        raw = data[offsets[first] : offsets[stop]]
        yield _block(raw, own, first, BYTE_VALUE if lower else BYTE_VALUE_CASED, between)
        first = stop


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, words, and the words one and two before; every row gets an end, and begins with BEGIN."""
    counts = words.counts()
    size = counts + 1
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    token = np.empty(size.sum(), U64)
    at = np.arange(len(words.hash)) + words.row
    token[at], token[first + counts] = words.hash, END
    row = np.repeat(np.arange(words.rows), size)
    before, earlier = np.roll(token, 1), np.roll(token, 2)
    before[first] = BEGIN
    earlier[first] = BEGIN
    second = first[size > 1] + 1
    earlier[second] = BEGIN
    return row, token, before, earlier


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `length` words, from running sums; runs may cross rows."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = _power_tables(len(hashes))
    sums = np.concatenate([[U64(0)], np.cumsum(hashes * up[: len(hashes)])])
    return mix((sums[length:] - sums[:-length]) * down[:n] + U64(length))


def _block(raw: np.ndarray, own: np.ndarray, first: int, value: np.ndarray, between: np.ndarray) -> Words:
    n = len(raw)
    inside = ~between[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = own[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(value[raw] * up[:n], out=sums[1:])
    digest = mix((sums[end] - sums[start]) * down[start])
    row = np.searchsorted(own, start, "right") - 1
    return Words(digest, row, start, end, raw, first, own)
