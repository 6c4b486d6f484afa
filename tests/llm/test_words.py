import random
import re

import numpy as np
import pyarrow as pa

from sqlcurate.llm import words as W
from sqlcurate.llm.lookup import Lookup, bits_at

PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB éß\n\t 字🙂.") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", "x" * 5000]
    want = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in PATTERN.findall(t or "")] for t in texts]
    got, seen = [[] for _ in texts], {}
    for block in W.words_of(*W.utf8(pa.array(texts))):
        for text, row, digest in zip(block.texts(np.arange(len(block.hash))), block.row.tolist(), block.hash.tolist(), strict=True):
            got[block.first_row + row].append(text)
            assert seen.setdefault(text, digest) == digest
    assert got == want
    assert len(set(seen.values())) == len(seen)


def test_blocks_hold_whole_rows(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 16)
    texts = ["a b", "c" * 50, "", "d e f g h", None, "i"]
    blocks = list(W.words_of(*W.utf8(pa.array(texts))))
    assert sum(b.rows for b in blocks) == len(texts)
    assert [n for b in blocks for n in b.counts().tolist()] == [2, 1, 0, 5, 0, 1]


def test_runs_are_equal_where_words_are():
    hashes = W.mix(np.array([1, 2, 3, 1, 2, 3, 2], np.uint64))
    runs = W.rolling(hashes, 3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 4


def test_ends():
    (block,) = W.words_of(*W.utf8(pa.array(["a b c", None])))
    row, token, before, earlier = W.with_ends(block)
    a, b, c = block.hash
    assert row.tolist() == [0, 0, 0, 0, 1]
    assert token.tolist() == [a, b, c, W.END, W.END]
    assert before.tolist() == [W.BEGIN, a, b, c, W.BEGIN]
    assert earlier.tolist() == [W.BEGIN, W.BEGIN, a, b, W.BEGIN]


def test_lookup():
    keys = W.mix(np.arange(5000, dtype=np.uint64))
    table = Lookup(keys)
    assert table.find(keys).tolist() == list(range(5000))
    assert (table.find(W.mix(np.arange(5000, 6000, dtype=np.uint64))) == -1).all()
    assert Lookup(np.empty(0, np.uint64)).find(keys[:3]).tolist() == [-1] * 3


def test_bits_of_a_packed_map():
    bits = np.random.default_rng(1).random(1 << 12) < 0.3
    places = np.random.default_rng(2).integers(0, len(bits), 5000)
    assert (bits_at(np.packbits(bits, bitorder="little"), places) == bits[places]).all()
    assert not len(bits_at(np.zeros(8, np.uint8), np.empty(0, np.int64)))
