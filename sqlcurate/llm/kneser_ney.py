"""Quality by the perplexity of interpolated modified Kneser-Ney trigram models of trusted text.

Trusted documents fall into two halves by a hash of their id, and one model is counted on all whole texts of each half.
A document is scored by the model of the half that it is not in, so all trusted documents teach, and all of them, scored
by a model that has not seen them, set the limits: a document is rejected if its perplexity lies above a quantile of
those of its language.

Trigrams are dealt to buckets by their middle word, as many as the bytes of the texts ask for. A bucket holds all that
the probabilities of two and three words need, but for the probabilities of single words, which come from the buckets
of those words. Texts meet the models in the buckets: their trigrams are dealt to them in blobs, each different one of a
block of texts once, and log probabilities are summed per text. A text's log10 is the sum over words of that of the word
alone, made in the bucket of the word, where the word is the middle one of the trigram behind, and of its ratio to that of
the word after its two predecessors, made in the bucket of the word before. No model is in one place.

The two models are counted and met one after the other, and each by a share of its documents at a time, so the trigrams
that lie on disk at once are those of that share.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sqlcurate.llm.key_filters import flagged
from sqlcurate.llm.lookup import Lookup
from sqlcurate.llm.rows import named
from sqlcurate.llm.words import BEGIN, END, U64, chain, mix, utf8, with_ends, words_of
from sqlcurate.llm.workers import giving_back, stored, stored_parts

#: Bound of the trusted texts of a language and half that teach, for trials; None is none.
TRAIN_DOCUMENTS: int | None = None
#: Quantile of trusted perplexities up to which documents stay, and the room above it on the log scale.
QUANTILE, SLACK = 0.99, 0.1
#: A short text is judged as if it had this many more tokens of its language's mean trusted perplexity.
PRIOR_TOKENS = 20
#: With fewer trusted documents a language is not judged by them alone.
LEAST_TRUSTED = 30
#: Models. Words are told apart by the upper 47 bits of their hashes, and the bit below them is the number of the model.
MODELS, MODEL_BIT = 2, 16
#: Shares in which the documents of a model are scored; their trigrams are on disk one share at a time.
SHARES = 3
#: Tokens of a block; bytes of text to a bucket; trigrams of a bucket for which one task scores texts.
BLOCK_TOKENS, BUCKET_BYTES, PART_GRAMS = 1 << 20, 1 << 24, 1 << 21


class Settings(NamedTuple):
    """What all buckets must know, per model: discounts of three, two and one words, and of single words the total and
    the probability of an unknown one."""

    d3: np.ndarray
    d2: np.ndarray
    d1: np.ndarray
    total: np.ndarray
    unknown: np.ndarray

    def p1(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = of_model(words)
        return (counts - less(self.d1, m, counts)) / self.total[m] + self.unknown[m]


class Model(NamedTuple):
    """Counts per bucket, the numbers of different predecessors of words, and what all buckets must know."""

    counts: DataFrame
    words: DataFrame
    fixed: Settings
    buckets: int
    taught: list[int]  # different words of each model


def of_model(words: np.ndarray) -> np.ndarray:
    return ((words >> U64(MODEL_BIT)) & U64(1)).astype(np.int64)


def less(d: np.ndarray, model: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return d[model, np.minimum(counts, 3) - 1]


def salted(words: np.ndarray, model: np.ndarray | int) -> np.ndarray:
    return (mix(words) & ~U64((2 << MODEL_BIT) - 1)) | (np.asarray(model).astype(U64) << U64(MODEL_BIT))


def of_all_models(word: U64) -> np.ndarray:
    return salted(np.full(MODELS, word), np.arange(MODELS))


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> U64(32)) * U64(buckets)) >> U64(32)


def pack(values: np.ndarray) -> bytes:
    """Byte by byte of all values, as those of small numbers are mostly zero."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps, which compress."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, U64))


def new(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    return out


def runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and their lengths."""
    begins = np.flatnonzero(new(*columns))
    return begins, np.diff(np.append(begins, len(columns[0])))


def steps(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of numbers that ascend within runs: those at the begins, and differences behind them."""
    out = np.diff(values, prepend=0)
    out[begins] = values[begins]
    return out.astype(np.uint32)


def walked(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """What `steps` was made of."""
    total = np.cumsum(found, dtype=np.int64)
    before = total[begins] - found[begins]
    return total - np.repeat(before, np.diff(np.append(begins, len(found))))


def pack_grams(u: np.ndarray, w: np.ndarray, v: np.ndarray) -> list[bytes]:
    """Trigrams in order of their columns, as places in a list of their words."""
    words, places = np.unique(np.concatenate([u, w, v]), return_inverse=True)
    u, w, v = np.split(places, 3)
    return [pack_keys(words), pack(steps(u, np.arange(min(len(u), 1)))), pack(steps(w, runs_of(u)[0])), pack(steps(v, runs_of(u, w)[0]))]


def unpack_grams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, (u, w, v) = unpack_keys(row["dict"]), (unpack(row[name], np.uint32) for name in ("u", "w", "v"))
    u = np.cumsum(u, dtype=np.int64)
    w = walked(w, runs_of(u)[0])
    return words[u], words[w], words[walked(v, runs_of(u, w)[0])]


GRAMS = {"dict": pa.binary(), "u": pa.binary(), "w": pa.binary(), "v": pa.binary()}
GRAM_TYPES = "dict binary, u binary, w binary, v binary"


class Block(NamedTuple):
    """Tokens of whole texts, in order of their trigrams, middle word first, hence of buckets."""

    number: int
    u: np.ndarray
    w: np.ndarray
    v: np.ndarray
    row: np.ndarray
    sizes: np.ndarray  # tokens per text
    texts: pa.RecordBatch | pa.Table
    edges: np.ndarray  # where buckets begin
    begins: np.ndarray  # where different trigrams begin
    runs: np.ndarray


def blocks_of(parts: Iterator[pa.RecordBatch], buckets: int) -> Iterator[Block]:
    """Of texts, the last column, by the model in the column before it."""
    number, held, tokens, texts = TaskContext.get().partitionId() << 24, [], 0, 0

    def done() -> Block:
        u, w, v, row, sizes, batches = zip(*held, strict=True)
        held.clear()
        u, w, v, row = (np.concatenate(x) for x in (u, w, v, row))
        order = np.lexsort((v, w, u))
        u, w, v, row = u[order], w[order], v[order], row[order]
        begins, runs = runs_of(u, w, v)
        edges = np.searchsorted(bucket_of(u, buckets), np.arange(buckets + 1, dtype=U64))
        return Block(number, u, w, v, row, np.concatenate(sizes), pa.Table.from_batches(batches), edges, begins, runs)

    for part in parts:
        model = part.column(part.num_columns - 2).to_numpy(zero_copy_only=False)
        for words in words_of(*utf8(part.column(part.num_columns - 1))):
            row, token, before, earlier = with_ends(words)
            m = model[words.first_row : words.first_row + words.rows][row]
            held.append((*(salted(x, m) for x in (before, token, earlier)), (row + texts).astype(np.uint32), words.counts() + 1, part.slice(words.first_row, words.rows)))
            tokens, texts = tokens + len(row), texts + words.rows
            if tokens >= BLOCK_TOKENS:
                yield done()
                number, held, tokens, texts = number + 1, [], 0, 0
    if held:
        yield done()


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from how many counts are 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in range(1, 4)]
    return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1)]


def tallies(model: np.ndarray, counts: np.ndarray) -> list[int]:
    """Per model: how many counts are 1 to 4, how many there are, and their sum."""
    out = []
    for m in range(MODELS):
        own = counts[model == m]
        out += [*(int((own == k).sum()) for k in range(1, 5)), len(own), int(own.sum())]
    return out


def summed(df: DataFrame, column: str) -> np.ndarray:
    """`tallies` over all rows: [model, 6]."""
    found = df.select(*[F.coalesce(F.sum(F.col(column)[k]), F.lit(0)) for k in range(6 * MODELS)]).first()
    return np.array(found, np.int64).reshape(MODELS, 6)


def train(texts: DataFrame, buckets: int | None = None) -> Model:
    """Of a table (text), or (model, text) with numbers of models: the models of all texts. Other columns are not read."""
    if "model" not in texts.columns:
        texts = texts.withColumn("model", F.lit(0))
    buckets = buckets or bucket_number(texts.select("text"))

    @giving_back
    def grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(parts, buckets):
            u, w, v = (x[block.begins] for x in (block.u, block.w, block.v))
            edges = np.searchsorted(block.begins, block.edges)
            for b in np.flatnonzero(np.diff(edges)):
                own = slice(edges[b], edges[b + 1])
                values = [b, *pack_grams(u[own], w[own], v[own]), pack(block.runs[own].astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], ["bucket", *GRAMS, "counts"])
            del block, u, w, v  # before the next is made

    def merged(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        u, w, v = (np.concatenate(x) for x in zip(*map(unpack_grams, rows), strict=True))
        order = np.lexsort((v, w, u))
        u, w, v = u[order], w[order], v[order]
        begins, _ = runs_of(u, w, v)
        counts = np.add.reduceat(np.concatenate([unpack(r["counts"], np.uint32) for r in rows])[order].astype(np.int64), begins)
        u, w, v = u[begins], w[begins], v[begins]
        first, before = runs_of(u, w)
        values = [rows[0]["bucket"], *pack_grams(u, w, v), pack(counts), len(counts), tallies(of_model(u), counts), tallies(of_model(u[first]), before)]
        return pa.table([pa.array([x], t) for x, t in zip(values, COUNTS.values(), strict=True)], list(COUNTS))

    made = texts.select("model", "text").mapInArrow(grams, f"bucket bigint, {GRAM_TYPES}, counts binary")
    counts = stored(made.groupBy("bucket").applyInArrow(merged, f"bucket bigint, {GRAM_TYPES}, counts binary, n bigint, triples array<bigint>, pairs array<bigint>"), "counts")

    @giving_back
    def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                u, w, _ = unpack_grams(row)
                first, _ = runs_of(u, w)
                words, n = np.unique(w[first], return_counts=True)
                edges = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1, dtype=U64))
                for b in np.flatnonzero(np.diff(edges)):
                    own = slice(edges[b], edges[b + 1])
                    values = [b, row["bucket"], pack_keys(words[own]), pack(n[own].astype(np.uint32))]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], ["home", "bucket", "keys", "n"])

    def answered(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [unpack_keys(r["keys"]) for r in rows]
        words, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(r["n"], np.uint32) for r in rows])).astype(np.int64)
        out = [(r["bucket"], False, r["keys"], pack(total[np.searchsorted(words, k)]), None) for r, k in zip(rows, keys, strict=True)]
        out.append((rows[0]["home"], True, pack_keys(words), pack(total), tallies(of_model(words), total)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), NUMBERS.values(), strict=True)], list(NUMBERS))

    asking = counts.select("bucket", *GRAMS).mapInArrow(asked, "home bigint, bucket bigint, keys binary, n binary")
    words = stored(asking.groupBy("home").applyInArrow(answered, "bucket bigint, own boolean, keys binary, before binary, singles array<bigint>"), "words")
    n3, n2, n1 = summed(counts, "triples"), summed(counts, "pairs"), summed(words.filter("own"), "singles")
    d3, d2, d1 = (np.array([discounts(list(n[:4])) for n in x]) for x in (n3, n2, n1))
    total, vocabulary = np.maximum(n1[:, 5], 1), n1[:, 4]
    cut = d1[:, 0] * n1[:, 0] + d1[:, 1] * n1[:, 1] + d1[:, 2] * (vocabulary - n1[:, 0] - n1[:, 1])
    unknown = np.where(vocabulary > 0, cut, 1.0) / total / (vocabulary + 1)
    return Model(counts.select("bucket", *GRAMS, "counts", "n"), words.drop("singles"), Settings(d3, d2, d1, total, unknown), buckets, vocabulary.tolist())


COUNTS = {"bucket": pa.int64(), **GRAMS, "counts": pa.binary(), "n": pa.int64(), "triples": pa.list_(pa.int64()), "pairs": pa.list_(pa.int64())}
NUMBERS = {"bucket": pa.int64(), "own": pa.bool_(), "keys": pa.binary(), "before": pa.binary(), "singles": pa.list_(pa.int64())}


def bucket_number(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)


class Bucket:
    """The models of one bucket, made from its counts and the numbers of its words.

    Words of a bucket share upper bits, by which lookups place keys, so these are mixed once more.
    """

    def __init__(self, state: list[dict], fixed: Settings):
        self.fixed = fixed
        told = [r for r in state if r["own"] is not None]
        known = {own: [(unpack_keys(r["keys"]), unpack(r["before"], np.int64)) for r in told if r["own"] == own] for own in (False, True)}
        joined = lambda parts, k: np.concatenate([x[k] for x in parts]) if parts else np.empty(0, (U64, np.int64)[k])
        words = joined(known[True], 0)
        self.words, self.p1 = Lookup(mix(words)), fixed.p1(words, joined(known[True], 1))
        grams = [(unpack_grams(r), unpack(r["counts"], np.int64)) for r in state if r["own"] is None]
        (u, w, v), c = grams[0] if grams else ([np.empty(0, U64)] * 3, np.empty(0, np.int64))
        words, order = joined(known[False], 0), np.argsort(joined(known[False], 0))
        single = fixed.p1(words, joined(known[False], 1))[order]
        m = of_model(u)
        first, before = runs_of(u, w)
        pairs, pair = chain(u[first], w[first]), np.repeat(np.arange(len(first)), before)
        middle, at1, left1, over1 = self.contexts(u[first], before, fixed.d2)
        p2 = (before - less(fixed.d2, m[first], before)) / over1[at1]
        q2 = p2 / single[np.searchsorted(words[order], w[first])] + left1[at1]  # over that of the word alone
        wider, at2, left2, over2 = self.contexts(chain(v, u), c, fixed.d3, m)
        q3 = (c - less(fixed.d3, m, c)) / over2[at2] / single[np.searchsorted(words[order], w)] + left2[at2] * q2[pair]
        self.pairs, self.q2, self.after1, self.left1 = Lookup(pairs), q2, Lookup(mix(middle)), left1
        self.triples, self.q3, self.after2, self.left2 = Lookup(chain(v, u, w)), q3, Lookup(wider), left2

    @staticmethod
    def contexts(keys: np.ndarray, counts: np.ndarray, d: np.ndarray, model: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Contexts, that of each key, and per context what is left for lower orders and the total."""
        found, at = np.unique(keys, return_inverse=True)
        over = np.bincount(at, counts, len(found))
        return found, at, np.bincount(at, less(d, of_model(keys) if model is None else model, counts), len(found)) / over, over

    @staticmethod
    def of(values: np.ndarray, rows: np.ndarray, otherwise: float | np.ndarray = 1.0) -> np.ndarray:
        return np.where(rows >= 0, values[rows], otherwise) if len(values) else np.zeros(len(rows)) + otherwise

    def alone(self, words: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word after nothing."""
        return np.log10(self.of(self.p1, self.words.find(mix(words)), self.fixed.unknown[of_model(words)]))

    def ratio(self, u: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """log10 of how many times that is the probability after v and u."""
        pair, triple = self.pairs.find(chain(u, w)), self.triples.find(chain(v, u, w))
        lower = self.of(self.q2, pair, self.of(self.left1, self.after1.find(mix(u))))
        return np.log10(self.of(self.q3, triple, lower * self.of(self.left2, self.after2.find(chain(v, u)))))

    def told(self, u: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The ratio, and beside it what the middle word, of which equal ones lie together, has alone; a text's begin has none."""
        first, n = runs_of(u)
        words = u[first]
        return self.ratio(u, w, v) + np.repeat(np.where(np.isin(words, of_all_models(BEGIN)), 0.0, self.alone(words)), n)


def scored(rows: DataFrame, model: Model, chosen: str | None = None) -> DataFrame:
    """`rows`, whose last column is the text, with tokens (words and one end) and log10 of its probability instead.

    The model is that of the number in the column `chosen`, which is left out too, by default the first.
    """
    buckets, fixed = model.buckets, model.fixed
    text = rows.schema.fields[-1].name
    fields = [f for f in rows.schema.fields[:-1] if f.name != chosen]
    held = rows.select(F.struct(F.lit(0).alias("_"), *[named(f.name) for f in fields]).alias("held"), (named(chosen) if chosen else F.lit(0)).cast("int").alias("model"), named(text).alias("text"))
    held_type = held.schema["held"].dataType.simpleString()
    split = {r["bucket"]: -(-r["n"] // PART_GRAMS) for r in model.counts.filter(F.col("n") > PART_GRAMS).select("bucket", "n").collect()}  # a number per bucket
    events = {"bucket": pa.int64(), "part": pa.int64(), "block": pa.int64(), "texts": pa.int64(), **GRAMS, "runs": pa.binary(), "rows": pa.binary(), "keys": pa.binary(), "key_runs": pa.binary(), "key_rows": pa.binary()}

    @giving_back
    def dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(parts, buckets):
            end = np.flatnonzero(np.isin(block.w, of_all_models(END)))  # no trigram has it in the middle
            end = end[np.lexsort((block.row[end], block.w[end]))]
            words, at = block.w[end], block.row[end].astype(np.int64)
            begins, runs = runs_of(words)
            words, edges = words[begins], np.searchsorted(block.begins, block.edges)
            word_edges = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1, dtype=U64))
            ends = np.append(begins, len(at))
            told = pa.array(block.texts.column(0).combine_chunks()) if block.texts.num_rows else None
            of, first = pa.list_(told.type), True  # the block's texts go with its first blob
            for b in np.flatnonzero(np.diff(edges) + np.diff(word_edges)).tolist():
                own, mine = block.begins[edges[b] : edges[b + 1]], slice(word_edges[b], word_edges[b + 1])
                values = [
                    b, int(mix(np.array([block.number], U64))[0] % U64(split.get(b, 1))), block.number, len(block.sizes),
                    *pack_grams(block.u[own], block.w[own], block.v[own]), pack(block.runs[edges[b] : edges[b + 1]].astype(np.uint32)),
                    pack(block.row[block.edges[b] : block.edges[b + 1]]), pack_keys(words[mine]), pack(runs[mine].astype(np.uint32)),
                    pack(steps(at[ends[mine.start] : ends[mine.stop]], begins[mine] - ends[mine.start])),
                ]
                arrays = [pa.array([x], t) for x, t in zip(values, events.values(), strict=True)]
                arrays += [pa.array([block.sizes.tolist() if first else None], pa.list_(pa.int64()))]
                arrays += [pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told) if first else pa.nulls(1, of)]
                yield pa.RecordBatch.from_arrays(arrays, [*events, "sizes", "held"])
                first = False
            arrays = told = None
            del block  # before the next is made

    more = f"sizes array<bigint>, held array<{held_type}>"
    names = ", ".join(f"{k} {'binary' if t == pa.binary() else 'bigint'}" for k, t in events.items())
    tokens = held.mapInArrow(dealt, f"{names}, {more}")

    def looked_up(tokens: pa.Table, state: pa.Table) -> pa.Table:
        bucket, sums = Bucket(state.to_pylist(), fixed), []
        for event in tokens.select(list(events)).to_pylist():
            total = np.zeros(event["texts"])
            runs, key_runs = unpack(event["runs"], np.uint32), unpack(event["key_runs"], np.uint32)
            total += np.bincount(unpack(event["rows"], np.uint32), np.repeat(bucket.told(*unpack_grams(event)), runs), event["texts"])
            at = walked(unpack(event["key_rows"], np.uint32), np.cumsum(key_runs, dtype=np.int64) - key_runs)
            total += np.bincount(at, np.repeat(bucket.alone(unpack_keys(event["keys"])), key_runs), event["texts"])
            sums.append(pack(total))
        return pa.table([tokens["block"], pa.array(sums, pa.binary()), tokens["sizes"], tokens["held"]], ["block", "sums", "sizes", "held"])

    state = model.counts.drop("n").unionByName(model.words, allowMissingColumns=True).withColumn("part", F.lit(0).cast("bigint"))
    if split:
        parts = F.create_map(*[F.lit(x) for pair in split.items() for x in pair])
        state = state.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(parts[F.col("bucket")], F.lit(1)).cast("bigint") - 1)))
    partial = tokens.groupBy("bucket", "part").cogroup(state.groupBy("bucket", "part")).applyInArrow(looked_up, f"block bigint, sums binary, {more}")

    def finished(group: pa.Table) -> pa.Table:
        total = sum(unpack(b, float) for b in group["sums"].to_pylist())
        sizes = np.concatenate([x for x in group["sizes"].to_pylist() if x is not None])
        told = group["held"].combine_chunks().flatten()
        return pa.table([told, pa.array(sizes, pa.int64()), pa.array(total)], ["held", "tokens", "log10"])

    out = partial.groupBy("block").applyInArrow(finished, f"held {held_type}, tokens bigint, log10 double")
    return out.select(*[F.col(f"held.`{f.name}`") for f in fields], "tokens", "log10")


def judge(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang",
    quality_column: str = "quality", quantile: float = QUANTILE, carried: list[str] | None = None,
) -> DataFrame:
    """Per row: doc (a struct of the carried columns, by default all), tokens, log10, score, limit, kept.

    `score` is the log10 perplexity, steadied for short texts. Trusted documents are those with a label of quality 1.
    A language (null is one) is judged by its own trusted documents; with fewer than LEAST_TRUSTED of them, by the wider
    of their limit and that of all languages. A null text is empty and has one token, its end. Ties with the limit are
    kept. Without trusted texts in both halves everything is kept. Rows that repeat are judged each. Labels that repeat count
    once, and a row without id is never trusted. An empty table gives an empty result.
    """
    ident, language, text = named(id_column), named(language_column), named(text_column)
    trusted = stored(labels.filter(named(quality_column) == 1).select(named(id_column).alias("id")).filter("id IS NOT NULL").distinct(), "trusted")
    half = F.coalesce(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)), F.lit(0)).cast("int")
    texts = flagged(docs.select(ident.alias("id"), language.alias("language"), text.alias("text")).filter(F.octet_length("text") > 0), trusted, ["id"])
    texts = texts.filter("_maybe").drop("_maybe").join(trusted, "id", "left_semi")
    if TRAIN_DOCUMENTS is not None:
        order = Window.partitionBy("language", half).orderBy(F.xxhash64("id"), "id")
        texts = texts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= TRAIN_DOCUMENTS)
    rows = docs.select(F.struct(*[named(c) for c in carried or docs.columns]).alias("doc"), ident.alias("id"), language.alias("language"), text.alias("text"))
    share, buckets = F.pmod(F.xxhash64("id", "text"), F.lit(SHARES)), bucket_number(docs.select(text.alias("text")))
    taught = []

    def parts() -> Iterator[DataFrame]:
        for number in range(MODELS):
            model = train(texts.filter(half == number).groupBy("id").agg(F.min("text").alias("text")).select("text"), buckets)  # an id that repeats teaches once
            taught.append(model.taught[0])
            for k in range(SHARES):
                yield scored(rows.filter((half != number) & (share == k)), model).withColumn("raw", -F.col("log10") / F.col("tokens"))

    made = stored_parts(parts(), "scored")
    known = made.select("id", "language", "tokens", "raw").join(trusted, "id", "left_semi").filter(F.lit(all(taught)))
    means = known.groupBy("language").agg(F.avg("raw").alias("mean"), F.count("*").alias("trusted"))
    overall = known.agg(F.avg("raw")).first()[0]
    if overall is None:
        return made.select("doc", "tokens", "log10", F.col("raw").alias("score"), F.lit(None).cast("double").alias("limit"), F.lit(True).alias("kept"))
    steadied = (F.col("raw") * F.col("tokens") + F.coalesce("mean", F.lit(overall)) * PRIOR_TOKENS) / (F.col("tokens") + PRIOR_TOKENS)
    same = F.col("language").eqNullSafe(F.col("of"))
    judged = known.join(means.select(F.col("language").alias("of"), "mean"), same).withColumn("score", steadied)
    limit = F.percentile_approx("score", quantile, 10000) + SLACK
    all_limit = judged.agg(limit).first()[0]
    own = F.when(F.count("*") >= LEAST_TRUSTED, limit).otherwise(F.greatest(limit, F.lit(all_limit)))
    limits = stored(judged.groupBy("of").agg(F.first("mean").alias("mean"), own.alias("limit")), "limits")  # a row per language
    out = made.join(limits, same, "left").select("doc", "tokens", "log10", steadied.alias("score"), F.coalesce("limit", F.lit(all_limit)).alias("limit"))
    return out.withColumn("kept", F.col("score") <= F.col("limit"))
