import math
import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from cases import ODD, WORDS, answers, table, texts
from pyspark.sql import functions as F

from sqlcurate.llm import decontamination, jaccard_join, kneser_ney, pitman_yor, sanitising, workers
from sqlcurate.llm.kneser_ney import judge
from sqlcurate.llm.language_id import identify
from sqlcurate.llm.pitman_yor import bucket_scores, fit, keys_of, score_texts, unpack_keys, words_in
from sqlcurate.llm.words import END, utf8, words_of
from sqlcurate.sources.storage import CLEANED, stored

PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def test_languages(spark):
    rng = random.Random(1)
    stock = {"xx": "ka lomi teru sanda", "yy": "öst grün fährt über", "zz": "ñandu corazón así día"}
    rows = [(3 * i + k, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randint(3, 30))), lang) for i in range(120) for k, lang in enumerate(stock)]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "123 !?", "zz"), (903, "ka lomi", None), (903, "ka lomi", None), (None, "öst über grün", "yy"), (904, "ka " * 60000, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS language")
    held = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    got = identify(docs, eligible=~held)
    assert got.count() == len(rows)
    found = {(r["doc_id"], r["lang_pred"]) for r in got.collect()}
    assert {(900, "und"), (901, "und"), (902, "und"), (903, "xx"), (904, "xx"), (None, "yy")} <= found
    held_out = got.join(docs.select("doc_id", "lang", "text"), "doc_id").filter(held & F.col("text").rlike("[a-z]"))
    assert got.filter("score NOT BETWEEN 0 AND 1").count() == 0
    truth = {(i, lang) for i, t, lang in rows if i is not None and i % 4 == 0 and t and i < 900}
    assert len({(r["doc_id"], r["lang_pred"]) for r in held_out.collect()} & truth) >= 0.95 * len(truth)
    nothing = identify(docs, eligible=F.lit(False))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    assert identify(docs.filter("false"), eligible=F.lit(True)).count() == 0


def brute_kneser_ney(sample, text):
    """log10 of a text by the definition, from counts in dictionaries."""
    c3 = Counter()
    for t in sample:
        w = ["<s>", "<s>", *tokens(t)]
        c3.update(zip(w, w[1:], w[2:]))
    c2 = Counter((u, w) for _, u, w in c3)
    c1 = Counter(w for _, w in c2)

    def cuts(c):
        n = [0, *(sum(v == k for v in c.values()) for k in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
        return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1)]

    d3, d2, d1 = cuts(c3), cuts(c2), cuts(c1)
    less = lambda d, c: d[min(c, 3) - 1]
    after = defaultdict(lambda: [0, 0.0])
    for (v, u, _), c in c3.items():
        after[v, u][0] += c
        after[v, u][1] += less(d3, c)
    for (u, _), c in c2.items():
        after[u][0] += c
        after[u][1] += less(d2, c)
    whole = sum(c1.values())
    left = sum(less(d1, c) for c in c1.values()) / whole
    out, w = 0.0, ["<s>", "<s>", *tokens(text)]
    for v, u, x in zip(w, w[1:], w[2:]):
        p = left / (len(c1) + 1) + ((c1[x] - less(d1, c1[x])) / whole if x in c1 else 0)
        for key, count, d in ((u, c2[u, x], d2), ((v, u), c3[v, u, x], d3)):
            if key in after:
                total, cut = after[key]
                p = cut / total * p + ((count - less(d, count)) / total if count else 0)
        out += math.log10(p)
    return out


def test_kneser_ney_by_definition(spark):
    sample = [t for _, t in texts(4, 60)] + ["the of the of", "", "the stone"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in sample], "text string"))
    unseen = [(i, t) for i, t in ODD] + texts(5, 10) + [(9, "stone river unheard the"), (10, "the " * 5000)]
    got = kneser_ney.scored(spark.createDataFrame(unseen, "doc_id long, text string"), model).collect()
    want = sorted(((i, len(tokens(t)), round(brute_kneser_ney(sample, t), 2)) for i, t in unseen), key=repr)
    assert sorted(((r["doc_id"], r["tokens"], round(r["log10"], 2)) for r in got), key=repr) == want


def test_judge(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TRAIN_DOCUMENTS", 60)
    rng = random.Random(6)
    good = texts(6, 300)
    bad = [(2000 + i, " ".join(f"{rng.choice(WORDS)}@#{rng.randrange(99)}" for _ in range(40))) for i in range(20)]
    docs = table(spark, ODD + good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:200]] + [(good[0][0], 1, 0), (None, 1, 0), (2000, 0, 0), (good[1][0], None, None)], "doc_id long, quality int, toxic int")
    got = judge(docs, labels)
    kept = [(r["doc"]["doc_id"], r["kept"]) for r in got.collect()]
    assert len(kept) == docs.count()
    assert not any(k for i, k in kept if (i or 0) >= 2000)
    assert sum(k for i, k in kept if 100 <= (i or 0) < 2000) >= 0.97 * len(good)
    assert got.select("doc.*").columns == docs.columns
    assert {r["kept"] for r in judge(docs, labels.filter("false")).collect()} == {True}
    assert judge(docs.filter("false"), labels).count() == 0


def test_kneser_ney_in_blocks_and_parts(spark, monkeypatch):
    sample, unseen = texts(4, 60), ODD + texts(5, 30) + [(10, "the " * 500)]
    rows = spark.createDataFrame(unseen, "doc_id long, text string")

    def found():
        model = kneser_ney.train(spark.createDataFrame([(t,) for _, t in sample], "text string"))
        return sorted(((r["doc_id"], r["tokens"], round(r["log10"], 6)) for r in kneser_ney.scored(rows, model).collect()), key=repr)

    whole = found()
    for name, value in {"BLOCK_TOKENS": 50, "BUCKET_BYTES": 500, "PART_GRAMS": 7}.items():
        monkeypatch.setattr(kneser_ney, name, value)
    assert found() == whole


def test_judge_learns_from_all_trusted_texts(spark):
    """Each trusted text, also a long one, is known to the model that scores the other half."""
    half = [r[0] for r in spark.range(2000).selectExpr("pmod(xxhash64(id, 3), 2)").collect()]
    other = [iter([i for i in range(700, 2000) if half[i] != h]) for h in (0, 1)]
    body = lambda name: " ".join(f"{name}x{k}" for k in range(8))
    trusted = [(i, body(f"t{i}") + (" stone" * 12000 if i == 5 else "")) for i in range(400)]
    probes = [(next(other[half[i]]), body(f"t{i}")) for i, _ in trusted]
    docs = spark.createDataFrame([*trusted, *probes, (5000, body("unheard"))], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    labels = spark.createDataFrame([(i, 1) for i, _ in trusted], "doc_id long, quality int")
    got = {r["doc"]["doc_id"]: r["log10"] for r in judge(docs, labels).collect()}
    assert len(got) == 801
    assert min(got[i] for i, _ in probes) > got[5000] / 2


def test_judge_meets_the_models_share_by_share(spark, monkeypatch):
    """Every row once, and never the trigrams of more than a part of them."""
    docs, met, whole = table(spark, ODD + texts(6, 600)), [], kneser_ney.scored
    monkeypatch.setattr(kneser_ney, "scored", lambda rows, *more: met.append(rows.count()) or whole(rows, *more))
    labels = spark.createDataFrame([(i, 1) for i in range(100, 400)], "doc_id long, quality int")
    assert judge(docs, labels).count() == sum(met) == docs.count()
    assert max(met) < 0.3 * docs.count()


def test_stored_leaves_no_shuffle_files(spark):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")

    before, setting = files(), spark.conf.get(CLEANED)
    tables = [stored(spark.range(1000).repartition(4, "id"), "spread") for _ in range(3)]  # kept, so that nothing is collected
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(CLEANED) == setting
    assert [t.count() for t in tables] == [1000] * 3


def test_workers_get_small_batches(spark):
    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.nbytes])], ["n"])

    setting = spark.conf.get(workers.BATCHES)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    for module in (kneser_ney, jaccard_join, decontamination, sanitising):
        got = [r["n"] for r in module.stored(rows.mapInArrow(sizes, "n bigint"), "sizes").collect()]
        assert sum(got) > 30e6 and max(got) < 5e6
    assert spark.conf.get(workers.BATCHES) == setting


def test_pitman_yor_base_and_held_out(spark):
    rows = ODD + texts(7, 200, 100) + [(5000, "stone " * 30000)]
    docs = table(spark, rows)
    train = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True))
    got = score_texts(docs, train)
    trained = [(i, t) for i, t in rows if i is None or i % 4 != 1]
    count = Counter(w for _, t in trained for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((i, i is None or i % 4 != 1, len(w), sum(x in count for x in w), n, round(base, 5)))
    out = got.withColumn("base", F.round("base_score", 5))
    assert answers(out, "doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base") == sorted(want, key=repr)
    held = got.filter("NOT trained AND n_tokens > 20").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    assert answers(score_texts(docs, train), "doc_id", "score") == answers(got, "doc_id", "score")
    assert score_texts(docs.filter("false"), train).count() == 0
    alone = score_texts(docs, F.lit(False)).collect()
    assert {r["n_known"] for r in alone} == {0} and all(math.isfinite(r["score"]) for r in alone)


def test_pitman_yor_chances_sum_to_one(spark):
    """Over the vocabulary and the unknown word, after any context."""
    sample = [t for _, t in texts(8, 80)]
    model = fit(spark.createDataFrame([(t,) for t in sample], "text string"))
    state = [r.asDict() for r in model.state.collect()]
    vocabulary = sorted({w for t in sample for w in tokens(t)[:-1]})
    (block,) = words_of(*utf8(pa.array([" ".join(vocabulary)])))
    word = np.concatenate([block.hash, [END]])
    assert model.fixed.vocabulary == len(word)
    for before in (word[0], word[7], np.uint64(12345)):
        keys = np.sort(keys_of(word, np.full(len(word), before)))
        total = 0.0
        for row in state:
            own = unpack_keys(row["keys"])
            mine = keys[np.isin(keys >> np.uint64(18), own[words_in(own)] >> np.uint64(18))]
            total += (10 ** bucket_scores(row, mine, model.samples, model.fixed)[0]).sum()
        unknown = 10 ** bucket_scores(None, keys_of(np.array([99], np.uint64), np.array([before])), model.samples, model.fixed)[0][0]
        assert abs(total + unknown - 1) < 1e-9


def test_seating_bounds():
    """Every dish has a table, and no more than customers; without mass for new tables it has one."""
    rng, customers = np.random.default_rng(0), np.array([1, 2, 3, 50, 4000, 10**7, 2, 9999])
    weight = np.array([1.0, 0.1, 5.0, 2.0, 30.0, 1e9, 0.0, 0.0])
    for _ in range(200):
        tables = pitman_yor.seated(rng, customers, weight, 0.7)
        assert (tables >= 1).all() and (tables <= customers).all() and tables[-2:].tolist() == [1, 1]
    assert pitman_yor.seated(rng, customers[:0], weight[:0], 0.7).tolist() == []


def test_gibbs_reaches_the_posterior():
    """Two customers of a dish: together with probability (1 - d) / (1 - d + weight)."""
    rng, n, d, a = np.random.default_rng(1), 40000, 0.6, 0.3
    tables = pitman_yor.seated(rng, np.full(n, 2), np.full(n, a), d)
    assert abs((tables == 1).mean() - (1 - d) / (1 - d + a)) < 0.01


def seatings(customers):
    """All ways to split customers into tables, as sizes."""
    if not customers:
        yield []
        return
    for sizes in seatings(customers - 1):
        yield [*sizes, 1]
        for k in range(len(sizes)):
            yield [*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]]


def chances(customers, weight, discount):
    """Brute force: chance of each number of tables, over all seatings."""
    out = np.zeros(customers + 1)
    for sizes in seatings(customers):
        out[len(sizes)] += weight ** len(sizes) * np.prod([np.prod([k - discount for k in range(1, n)]) for n in sizes])
    return out / out.sum()


def test_table_counts_follow_their_distribution():
    """A Gibbs step for all customers of a dish against all seatings of a few customers."""
    rng, discount, dishes = np.random.default_rng(4), 0.6, 20_000
    for customers, weight in [(1, 0.5), (2, 0.3), (5, 0.05), (7, 0.8), (8, 4.0)]:
        want = chances(customers, weight, discount)
        got = pitman_yor.seated(rng, np.full(dishes, customers), np.full(dishes, weight), discount)
        assert np.abs(np.bincount(got, minlength=customers + 1) / dishes - want).max() < 0.02, (customers, weight)


def test_saddle_point_is_near_the_exact_distribution():
    """Mean and spread at the largest number of customers that are seated exactly; beyond it the error falls further."""
    rng, dishes = np.random.default_rng(5), 20_000
    count = np.full(dishes, pitman_yor.WHOLE)
    for discount in (0.2, 0.6, 0.8):
        for weight in (0.01, 0.3, 1.0, 5.0, 20.0, 100.0, 1000.0):
            weights = np.full(dishes, weight)
            whole = pitman_yor.seated_whole(rng, count, weights, discount)
            many = pitman_yor.seated_many(rng, count, weights, discount)
            assert abs(whole.mean() - many.mean()) < 0.03 * whole.mean() + 0.5, (discount, weight, whole.mean(), many.mean())
            assert abs(whole.std() - many.std()) < 0.1 * whole.std() + 0.1, (discount, weight, whole.std(), many.std())
    huge = pitman_yor.seated_many(rng, np.array([10**9, 10**9]), np.array([1e-9, 1e7]), 0.7)
    assert huge[0] == 1 and 0.5e7 < huge[1] < 1.5e7
