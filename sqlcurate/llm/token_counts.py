"""Token counts of whole texts by rank-synchronous merging.

Pre-tokens of a batch are held as one ragged numpy array of symbols. In every round each sequence finds the
lowest-ranked pair it holds, and all sequences apply theirs at the same time, until none has a pair left;
the surviving symbols are the tokens. Equal pre-tokens of a task are merged once and remembered.

Rounds are about as many as the different pairs of the longest sequence, and each costs what is left of it. A
sequence of more than LONG symbols (text without spaces) takes no part in them: a queue of its pairs, by rank and
place, makes the same merges in time that grows with its length.

Texts are cut where no piece of the vocabulary can reach across: before a run of spaces and around line
feeds. That changes no merge. The vocabulary is read from the sentencepiece model; nothing is trained.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
NONE = np.iinfo(np.int32).max
#: Pre-tokens remembered by a task; beyond it the memory starts anew, results stay the same.
REMEMBERED = 400_000
#: Symbols beyond which a sequence is merged from a queue.
LONG = 256
#: Bytes of text whose pre-tokens are merged together; a longer text is a block of its own.
BLOCK = 1 << 20


class MergeTable:
    """Pieces, and for each pair of pieces whose join is a piece: its rank and the joined piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError(f"{path}: only BPE models that keep text as it is are supported")
        self.prefix, self.byte_fallback = norm.add_dummy_prefix, spec.byte_fallback
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError(f"{path}: a piece reaches over a cut of the text")
        ids = {p: i for i, p in enumerate(pieces)}
        for char in sorted({c for p in pieces for c in p} - ids.keys()):
            ids[char] = len(ids)
        self.vocabulary = len(pieces)
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        ranks = {score: rank for rank, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.width = len(ids) + 1
        keys, merged = [], []
        alone = np.ones(len(ids), bool)  # no longer piece that starts or ends with it comes as early
        for piece, score in pieces.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                for part in (piece[:cut], piece[cut:]):
                    if part in pieces and score >= pieces[part]:
                        alone[ids[part]] = False
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    merged.append(ids[piece])
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        rank_of = np.zeros(len(ids), np.int32)
        rank_of[[ids[p] for p in pieces]] = [ranks[s] for s in pieces.values()]
        self.rank_of, self.alone = rank_of, alone
        self.rank, self.of_pair = rank_of.tolist(), dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined piece of each pair, -1 if there is none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def queued(self, symbol: np.ndarray) -> int:
        """Merges of one long sequence: the lowest rank first, of equal ones the leftmost."""
        made = self.joined(symbol[:-1], symbol[1:])
        at = np.flatnonzero(made >= 0)
        queue = list(zip(self.rank_of[made[at]].tolist(), at.tolist(), symbol[at].tolist(), symbol[at + 1].tolist(), made[at].tolist(), strict=True))
        heapq.heapify(queue)
        held, size = symbol.tolist(), len(symbol)
        after, before, merges = list(range(1, size + 1)), list(range(-1, size - 1)), 0
        while queue:
            _, here, left, right, piece = heapq.heappop(queue)
            there = after[here]
            if held[here] != left or there >= size or held[there] != right:
                continue  # one of the two has been merged since
            held[here], held[there] = piece, -1
            after[here] = later = after[there]
            merges += 1
            if later < size:
                before[later] = here
            for first, second in ((before[here], here), (here, later)):
                if first >= 0 and second < size and (found := self.of_pair.get(held[first] * self.width + held[second])) is not None:
                    heapq.heappush(queue, (self.rank[found], first, held[first], held[second], found))
        return merges

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol, word = self.of_char[codes], np.repeat(np.arange(len(words)), sizes)
        unknown = (symbol < 0) | (symbol >= self.vocabulary)
        weight = np.ones(len(codes), np.int64)
        if self.byte_fallback:  # a character that is no piece becomes its bytes; otherwise a run of them one token
            weight[unknown] = (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))[unknown]
        else:
            weight[1:][unknown[1:] & unknown[:-1] & (word[1:] == word[:-1])] = 0
        total = np.bincount(word, weight, len(words)).astype(np.int64)

        for long in np.flatnonzero(sizes > LONG).tolist():
            past = int(sizes[: long + 1].sum())
            total[long] -= self.queued(symbol[past - sizes[long] : past])
        stay = (sizes <= LONG)[word]
        symbol, word = symbol[stay], word[stay]

        pair = np.full(len(symbol), -1, np.int32)  # what a symbol and the next one make
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.joined(symbol[inner], symbol[inner + 1])
        while True:
            rank = np.where(pair >= 0, self.rank_of[pair], NONE)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
            if not len(start):
                return total
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(word)))
            live = best < NONE
            here = np.repeat(np.where(live, best, -1), length)
            chosen = np.flatnonzero(rank == here)
            if not len(chosen):
                return total
            first = np.concatenate([[True], word[chosen[1:]] != word[chosen[:-1]]])
            # Another occurrence of the pair is merged in the same round if nothing new can come before it.
            lead = np.flatnonzero(first)
            piece = pair[chosen]
            same = piece == np.repeat(piece[lead], np.diff(np.append(lead, len(chosen))))
            chosen = chosen[first | (self.alone[piece] & same)]
            run = np.concatenate([[True], np.diff(chosen) != 1])  # overlapping occurrences: every other one
            since = np.arange(len(chosen)) - np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[since % 2 == 0]

            symbol[chosen] = pair[chosen]
            total -= np.bincount(word[chosen], minlength=len(words))
            keep = np.repeat(live, length)
            keep[chosen + 1] = False
            touched = np.zeros(len(word), bool)
            touched[chosen] = True
            # A merged symbol changes the pair it begins and the pair that ends in it.
            symbol, word, pair, touched = symbol[keep], word[keep], pair[keep], touched[keep]
            again = np.flatnonzero(touched)
            again = np.unique(np.concatenate([again, again[again > 0] - 1]))
            pair[again] = -1
            again = again[again + 1 < len(word)]
            again = again[word[again] == word[again + 1]]
            pair[again] = self.joined(symbol[again], symbol[again + 1])


def pre_tokens(text: str, prefix: bool = True) -> list[str]:
    return PRE_TOKEN.findall((SPACE if prefix else "") + text.replace(" ", SPACE)) if text else []


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    A null or empty text has no bytes and no tokens. Rows that repeat are counted each; further columns are
    not read. An empty table gives an empty result. `model_path` is a file that every executor has.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = MergeTable(model_path), {}
        for part in parts:
            counts, first = np.zeros(part.num_rows, np.int64), 0
            ends = np.cumsum(np.asarray(part.column(2)))
            while first < part.num_rows:  # a block of about BLOCK bytes is merged at once
                past = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right"))
                past = max(past, first + 1)
                tokens = [pre_tokens(text or "", table.prefix) for text in part.column(1).slice(first, past - first).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                if new := list(set().union(*tokens).difference(known)):
                    known.update(zip(new, table.count(new).tolist(), strict=True))
                counts[first:past] = [sum(map(known.__getitem__, of_text)) for of_text in tokens]
                first = past
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts), pa.array(counts > limit)], names)

    names = [id_column, "n_bytes", "n_tokens", "over_limit"]
    kind = dict(docs.dtypes)[id_column]
    sizes = docs.selectExpr(f"`{id_column}`", f"`{text_column}`", f"coalesce(octet_length(`{text_column}`), 0L) AS n_bytes")
    return sizes.mapInArrow(batches, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
