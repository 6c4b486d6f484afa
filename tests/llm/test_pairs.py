import random
import re
import time

import numpy as np
from cases import ODD, WORDS, answers, sentence, table, texts

from sqlcurate.llm import jaccard_join
from sqlcurate.llm.components import components
from sqlcurate.llm.decontamination import decontaminate, leaks, tiles
from sqlcurate.llm.jaccard_join import similar

PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, length):
    words = PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))) if words else frozenset()


def brute(rows, length, percent):
    """Per row: id, size of its set, smallest id reachable by links."""
    sets, root = [shingles(t, length) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), (min(own) if own else None) if sets[k] else i))
    return sorted(out, key=repr)


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(10**6))
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows, base, passage = ODD + texts(seed, 40), sentence(rng, 150), sentence(rng, 60)
    rows += [(1000 + i, edited(rng, base, rng.choice([0, 1, 1, 2, 2, 3, 4, 6]))) for i in range(60)]  # near copies of one text
    rows += [(2000 + i, passage + " " + sentence(rng, rng.randint(2, 40))) for i in range(30)]  # one common passage
    chain = base.split()
    for i in range(12):  # a chain whose ends are far apart
        chain = chain[3:] + [f"tail{i}{k}" for k in range(3)]
        rows.append((3000 + i, " ".join(chain)))
    return rows


def test_components_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELLS", 1 << 20)
    monkeypatch.setattr(jaccard_join, "BLOCK_ENTRIES", 16)
    for seed, length, percent in ((1, 3, 90), (2, 5, 80)):
        rows = corpus(seed)
        got = similar(table(spark, rows), length, percent)
        assert answers(got, "doc_id", "n_shingles", "component_id") == brute(rows, length, percent)


def test_few_cells_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELLS", 1 << 10)  # hardly any shingle looks rare
    monkeypatch.setattr(jaccard_join, "PARTS", 8)
    rows = corpus(3)
    assert answers(similar(table(spark, rows), 5, 80), "doc_id", "n_shingles", "component_id") == brute(rows, 5, 80)


def test_empty_table(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELLS", 1 << 20)
    assert similar(table(spark, ODD).filter("false")).count() == 0
    assert len(answers(similar(table(spark, ODD)), "doc_id")) == len(ODD)


def test_components_of_long_and_wide_links(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (205, 203), (203, 205)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    want = {(i, 0) for i in range(61)} | {(100 + i, 100) for i in range(40)} | {(203, 203), (205, 203)}
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)


def slow_tiles(a, b, shortest):
    """Greedy tiling by its definition."""
    free_a, free_b, found = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, -i, -j)
        if best[0] < shortest:
            return found
        n, i, j = best[0], -best[1], -best[2]
        found.append((i, j, n))
        free_a[i : i + n] = free_b[j : j + n] = [False] * n


def test_tiles_cover_what_the_definition_covers():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(3, 40))] for _ in "ab")
        got = tiles(*(np.array(x, np.uint64) for x in (a, b)), 3)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        assert len({k for i, _, n in got for k in range(i, i + n)}) == sum(n for *_, n in got)
        assert [n for *_, n in got] == sorted((n for *_, n in got), reverse=True)
        assert got == slow_tiles(a, b, 3)


def test_tiles_of_repeated_words_take_room_for_their_words_only():
    same = np.ones(20000, np.uint64)
    began = time.process_time()
    assert tiles(same, same[:2000], 5) == [(0, 0, 2000)]
    assert tiles(same[:3], same, 5) == tiles(same[:0], same, 5) == tiles(same, same[:0], 5) == []
    turns = np.arange(20000, dtype=np.uint64) % 7
    assert tiles(turns, np.concatenate([turns[3:50], same[:5] * np.uint64(99), turns[:900]]), 5) == [(0, 52, 900), (906, 0, 47)]
    assert time.process_time() - began < 5


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, 40)) for i in range(6)] + [(6, "tiny item"), (7, None), (8, "..."), (None, sentence(rng, 30))]
    parts = items[0][1].split()
    rows = ODD + texts(9, 40) + [
        (1000, sentence(rng, 30) + " " + items[1][1].upper() + ". " + sentence(rng, 20)),  # as it is, but for case and marks
        (1001, " ".join([*parts[20:], *sentence(rng, 5).split(), *parts[:20]])),  # in another order
        (1002, " ".join(parts[:12]) + " " + sentence(rng, 50)),  # too little of it
        (1003, "see the Tiny, item here"), (1004, items[2][1]), (1004, items[2][1]), (None, items[3][1]), (1005, items[9][1]),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS row", "2 AS words", "3 AS doc_id")
    docs = table(spark, rows)
    got = leaks(docs, benchmark)
    want = [(1000, 1, 1), (1001, 0, 2), (1003, 6, 1), (1004, 2, 1), (1004, 2, 1), (None, 3, 1), (1005, None, 1)]
    assert answers(got, "doc_id", "item_id", "n_tiles") == sorted(want, key=repr)
    clean = decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    gone = {1000, 1001, 1003, 1004, 1005}
    assert answers(clean, "doc_id", "text") == sorted(((i, t) for i, t in rows if i not in gone and t != items[3][1]), key=repr)
    assert leaks(docs, benchmark.filter("false")).count() == 0
    assert leaks(docs.filter("false"), benchmark).count() == 0


def test_counts_of_classes_do_not_wrap(spark, monkeypatch):
    """More than 65,535 shared shingles of one class, as in texts of millions of words."""
    monkeypatch.setattr(jaccard_join, "CELLS", 1 << 20)
    monkeypatch.setattr(jaccard_join, "KINDS", 1)
    words = [f"w{k}" for k in range(70000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], *(f"x{k}" for k in range(9))]))]
    docs = jaccard_join.rows_of(table(spark, rows), "doc_id", "text")
    seen = jaccard_join.prefixes(spark, docs, 5, 80, 100).selectExpr("set", "size", "kinds", "set AS root", "explode(arrays_zip(token, place)) AS e")
    found = jaccard_join.left_over(seen.select("set", "size", "kinds", "root", "e.token", "e.place").filter("place < 50"), 80, 100)
    assert found.count() == 1
