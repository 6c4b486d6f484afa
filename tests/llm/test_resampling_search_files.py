import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import ODD, answers, sentence, table, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sqlcurate.llm.importance_resampling import Features, Head, head_of, resample, with_ranks
from sqlcurate.llm.ranked_search import K2Treap, ranked_search
from sqlcurate.llm.token_files import EliasFano, Encoder, TokenFile, elias_fano, encoder, file_image, read_token_files, with_global_starts, write_token_files
from sqlcurate.llm.words import SPACE_AND_MARKS, utf8, words_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MORE = [(8, "Ünïcode WÖRDS, a-b_c É " * 9), (9, "the " * 5000), (-4, "x" * 3000 + " stone"), (10, sentence(random.Random(4), 4000))]


def words(text):
    return PATTERN.findall((text or "").translate(UPPER))


def features(text, runs):
    found = words(text)
    return [" ".join(found[i : i + n]) for n in range(1, runs + 1) for i in range(len(found) - n + 1)]


def brute_resample(rows, target, share, runs, least, seed=2024, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in some for f in features(text, runs)) for some in ([x for _, x in rows], target))
    total = {k: float(n + buckets) for k, n in (("s", sum(s.values())), ("t", sum(t.values())))}
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * total["s"] / (float(s[b] + 1) * total["t"]))) for b in {*s, *t}}
    out = []
    for i, text in rows:
        own = features(text, runs)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(able[: share * len(able) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("runs", "head"), [(1, 4096), (1, 3), (2, 4096), (2, 5), (3, 20)])
def test_resample(spark, runs, head):
    rows, target = ODD + MORE + texts(7, 60), [t for _, t in texts(8, 6)] + [None, ""]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(table(spark, rows), items, share=30, runs=runs, least_words=5, head=head)
    want = brute_resample(rows, target, 30, runs, 5)
    assert answers(got, "doc_id", "n_features", "weight", "score", "rank") == sorted(want, key=repr)


def test_resample_without_rows(spark):
    none = table(spark, ODD).filter("false")
    assert resample(none, none).count() == 0
    assert resample(table(spark, ODD), none, least_words=0, share=100).agg(F.count("rank")).first()[0] == len(ODD)


def test_head_is_the_most_frequent(spark):
    rows = texts(9, 50)
    head = head_of(table(spark, rows).coalesce(1), "text", 2, size=5)  # one task hands on all that it counts
    counted = Counter(w for _, t in rows for w in words(t))
    fifth = sorted(counted.values())[-5]
    by_crc = {zlib.crc32(w.encode()): n for w, n in counted.items()}
    assert all(by_crc[int(crc)] >= fifth for crc in head.crcs) and len(head.pairs) == 5


def test_crcs_of_the_tail():
    import pyarrow as pa

    rows = ["Éa ß " + "long" * 40 + " b", "", "x"]
    empty = Head(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint64), np.empty(0, np.uint32))
    [block] = words_of(*utf8(pa.array(rows)), between=SPACE_AND_MARKS)
    got = [int(c) for _, crcs in Features(empty, 3).of(block) for c in crcs]
    assert got == [zlib.crc32(f.encode()) for n in (1, 2, 3) for r in rows for f in features(r, n)[len(features(r, n - 1)) :]]


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("score"), F.col("id").alias("doc_id"))
    ranked = with_ranks(rows, F.col("doc_id") % 3 != 0, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], 40).collect()
    able = sorted((r for r in ranked if r["doc_id"] % 3), key=lambda r: (-r["score"], r["doc_id"]))
    cut = 40 * len(able) // 100
    assert [r["rank"] for r in able] == [*range(1, cut + 1), *[None] * (len(able) - cut)]
    assert not [r for r in ranked if r["doc_id"] % 3 == 0 and r["rank"]]


def brute_search(rows, items, k):
    docs = [(i, Counter(words(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize(("block", "pass_terms"), [(1 << 13, 1 << 16), (7, 20), (1, 1)])
def test_ranked_search(spark, monkeypatch, block, pass_terms):
    monkeypatch.setattr("sqlcurate.llm.ranked_search.BLOCK_DOCUMENTS", block)
    monkeypatch.setattr("sqlcurate.llm.ranked_search.PASS_TERMS", pass_terms)
    rows = ODD + MORE + texts(5, 80) + [(500 + i, "equal words tie here") for i in range(15)]
    asked = [(1, "river stones under light"), (2, "WORDS tie"), (2, "WORDS tie"), (3, None), (4, "nowhere"), (None, "the of one"), (5, sentence(random.Random(1), 300))]
    items = spark.createDataFrame(asked, "item_id int, text string").withColumn("doc_id", F.lit("x"))
    got = ranked_search(table(spark, rows), items, k=10)
    assert answers(got, "item_id", "rank", "doc_id", "score") == sorted(brute_search(rows, asked, 10), key=repr)


def test_ranked_search_without_rows(spark):
    items = spark.createDataFrame([("a", "the of")], "item_id string, text string")
    docs = table(spark, ODD + texts(1, 5))
    assert ranked_search(docs.filter("false"), items).count() == 0
    assert ranked_search(docs.filter("text IS NULL"), items).count() == 0
    assert ranked_search(docs, items.filter("false")).count() == 0


def test_treap_search_is_exact():
    rng = np.random.default_rng(3)
    for rows, columns, n in [(1, 1, 1), (3, 200, 150), (300, 5, 400), (60, 700, 9000)]:
        cells = np.unique(rng.integers(0, rows * columns, n))
        row, column, impact = cells // columns, cells % columns, rng.integers(1, 10**6, len(cells))
        grid = np.zeros((rows, columns), np.int64)
        grid[row, column] = impact
        treap = K2Treap(row, column, impact, max(rows - 1, columns - 1).bit_length())
        for _ in range(20):
            asked = rng.choice(rows, min(rows, 8), replace=False)
            weights = rng.integers(0, 9000, len(asked))
            scores = (grid[asked] * weights[:, None]).sum(axis=0)
            found, got = treap.search(asked, weights, 1, 10)
            assert (scores[found] == got).all() and len(set(found.tolist())) == len(found)
            want = np.sort(scores[scores > 0])[::-1][:10]
            assert np.sort(got)[::-1][: len(want)].tolist() == want.tolist()
            if len(want) == 10:
                assert set(np.flatnonzero(scores >= want[-1])) == set(found.tolist())  # ties too


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, largest in [(0, 0), (1, 0), (1, 2**64 - 1), (10, 3), (1000, 10**6), (70_000, 10**9), (5000, 2**63), (513, 2**40)]:
        values = np.sort(rng.integers(0, largest, n, dtype=np.uint64, endpoint=True))
        coded = EliasFano(b"12345678" + (raw := elias_fano(values)) + b"tail", 8)
        assert coded.end == 8 + len(raw) and (coded.select(np.arange(n)) == values).all()
        assert (coded.select(some := rng.permutation(n)[:99]) == values[some]).all()
        if n >= 1000:
            assert 8 * len(raw) / n < 3 + max(0, math.log2(largest / n)) + 0.5  # against 64 in a table


def test_one_file_is_read_in_place():
    ids = [np.array(x, "<u2").tobytes() for x in ([5, 6], [], [7], [8, 9, 10], [1])]
    file = TokenFile(file_image(ids, [None, -3, 4, 4, 90], 2, 1, 0) + b"\n")
    assert [file.document(i).tolist() for i in range(5)] == [[5, 6], [], [7], [8, 9, 10], [1]]
    assert file.doc_ids() == [None, -3, 4, 4, 90]
    assert [list(file.places(i)) for i in (-9, -3, 4, 5, 90, 91)] == [[], [1], [2, 3], [], [4], []]


def test_pieces_have_the_ids_of_whole_texts():
    library, rng = Tokenizer.from_file(TOKENIZER), random.Random(2)
    with open(TOKENIZER, encoding="utf-8") as file:
        encode = Encoder(file.read(), 1, 2)
    assert encode.parts
    alphabet = [*"aeinrstLJIΣσßéÉñ0123 \n\n\t\x0b\x1c\x85\u3000\xa0.,;:!?'\"<|>-_\u0301\u030c\u0307\u0345🙂漢",
                "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'LL", " ", " ", "word", "Word,", "É×.", "ça,"]
    some = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(4000)] + ["".join(map(chr, range(0xC0, 0x250))), *map(chr, range(0x250)), "", "J\u030c a\u0301 İ", "don't. DON'T? it's, 'S."]
    got = [np.frombuffer(raw, "<u2").tolist() for raw in encode(some)]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in some]


def test_other_tokenizers_see_whole_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encode = Encoder(described := file.read(), None, 4)
    assert not encode.parts
    some = ["two  words\n here ", "", "<|endoftext|> x"]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in encode(some)] == [Tokenizer.from_str(described).encode(t, add_special_tokens=False).ids for t in some]


def test_encoder_asks_only_for_new_pieces():
    with open(TOKENIZER, encoding="utf-8") as file:
        described = file.read()
    encode = encoder(described, 1, 2)
    encode.pieces.update((f"{i}x", b"") for i in range(1_000_000))
    began = time.process_time()
    for _ in range(100):
        encode(["the river"])
    assert time.process_time() - began < 0.5  # walking the kept pieces each time takes seconds
    assert encoder(described, 1, 2) is encode  # a worker's next task goes on with them
    encoder.cache_clear()


@pytest.mark.parametrize("file_ids", [1 << 22, 500])
def test_token_files(spark, tmp_path, file_ids):
    library = Tokenizer.from_file(TOKENIZER)
    rows = ODD + MORE + texts(2, 70) + [(11, "<|endoftext|> héllo <|startoftext|>\x00"), (2**40, "far away")]
    path = f"{tmp_path}/files"
    write_token_files(table(spark, rows), path, TOKENIZER, file_ids=file_ids)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    assert (files.count() > 5) == (file_ids == 500)
    read = read_token_files(spark, path, ids=True)
    got = [tuple(r) for r in with_global_starts(read).orderBy("start", "place").select("doc_id", "start", "n_tokens", "ids_crc32", "ids").collect()]
    tokens = sorted(((i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [i for i, _ in tokens]
    assert sorted((r[0] or 0, r[4]) for r in got) == sorted((i or 0, own) for i, own in tokens)
    start = 0
    for _, begins, n, crc, ids in got:
        assert begins == start and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n


def test_token_files_without_rows(spark, tmp_path):
    write_token_files(table(spark, ODD).filter("false"), f"{tmp_path}/none", TOKENIZER)
    assert with_global_starts(read_token_files(spark, f"{tmp_path}/none")).count() == 0
