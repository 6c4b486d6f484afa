import gzip
import hashlib
import random
import re

import numpy as np
from cases import ODD, WORDS, answers, sentence, table, texts

import corpus_pipeline
from sqlcurate.llm import jaccard_join
from sqlcurate.llm.mixing import mix_sources, mixed_texts, permuted, taken
from sqlcurate.llm.sanitising import base_spans, private_spans, sanitised, span_text
from sqlcurate.llm.warc import assemble, read_warc, write_warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def shares(sizes, weights=(1, 2, 3)):
    """Targets by the stated rule: share, fill what is above three times its size, share the excess anew."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest, open_ = total - sum(3 * sizes[s] for s in full), [s for s in names if s not in full]
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        index, one = np.arange(n), np.ones(n, np.int64)
        orders = [permuted(one * s, one * t, index, one * n).tolist() for s in (0, 5) for t in (0, 1)]
        assert all(sorted(o) == index.tolist() for o in orders)
        if n >= 64:
            assert len(set(map(tuple, orders))) == 4


def test_mixture(spark):
    rows = ODD + texts(11, 150, 200) + [(5000, "w " * 20000)]
    docs = table(spark, rows)
    plan = mix_sources(docs)
    got = taken(plan)
    source = {}
    for r in docs.collect():
        source.setdefault(r["source"], 0)
        source[r["source"]] += size(r["text"])
    target = shares(source)
    told = {r["source"]: (r["source_size"], round(r["target"], 6)) for r in plan.sources.collect()}
    assert told == {s: (n, round(target[s], 6)) for s, n in source.items()}
    out = got.collect()
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=repr) == sorted(((i, size(t)) for i, t in rows), key=repr)
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    by_target = {}
    for r in out:
        by_target.setdefault((r["target"], r["source_size"]), [0, r["target"]])[0] += r["taken"]
    assert all(abs(n - want) <= 150 for n, want in by_target.values())
    assert answers(taken(mix_sources(docs.repartition(5))), "doc_id", "taken") == answers(got, "doc_id", "taken")
    blocks = mixed_texts(plan, docs)
    assert blocks.count() == plan.slots.count()
    assert sum(size(r["text"]) for r in blocks.collect()) == sum(r["taken"] for r in out)
    assert taken(mix_sources(docs.filter("false"))).count() == 0


def test_shards_draw_source_counts(spark):
    rows = texts(12, 400, 300)
    docs = table(spark, rows)
    plan = mix_sources(docs, block_words=8, slots_per_shard=100)
    slots = plan.slots.collect()
    shards, of_source, blocks = {}, {}, {}
    for r in slots:
        shards.setdefault(r["shard"], []).append(r["slot"])
        of_source.setdefault(r["source_no"], {}).setdefault(r["shard"], []).append(r["block"])
        blocks.setdefault((r["source_no"], r["block"]), []).append(r["shard"])
    last = max(shards)
    assert sorted(shards) == list(range(last + 1)) and last > 5
    assert all(sorted(own) == list(range(100 if k < last else len(own))) for k, own in shards.items())
    told = {r["source_no"]: r for r in plan.sources.filter("n_slots > 0").collect()}
    assert {s: sum(map(len, own.values())) for s, own in of_source.items()} == {s: r["n_slots"] for s, r in told.items()}
    for s, r in told.items():  # a source's blocks are used in turns, and its counts spread as a draw does
        uses = [len(blocks.get((s, b), ())) for b in range(r["n_blocks"])]
        assert max(uses) - min(uses) <= 1
        share = r["n_slots"] / len(slots)
        spread = [len(of_source[s].get(k, ())) - 100 * share for k in range(last)]
        assert all(abs(x) <= 6 * (100 * share * (1 - share)) ** 0.5 + 1 for x in spread)
    assert len({tuple(len(own.get(k, ())) for own in of_source.values()) for k in range(last)}) > 1
    again = mix_sources(docs.repartition(7), block_words=8, slots_per_shard=100)
    assert sorted(again.slots.collect()) == sorted(slots)


def test_archives(spark, tmp_path):
    same = "<p>" + "equal " * 40
    pages = [(3, "http://a/3", same), (1, "http://a/1", same), (2, None, same), (2, None, same), (4, "http://a/\r\nX: 4", "short"), (5, "u", "short"), (6, "u", None),
             (7, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3), (8, "u", "é字🙂" * 50000), (None, "u", same), (9, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest", "3 AS first").repartition(3)
    path = str(tmp_path / "archive")
    write_warc(df, path)
    got = assemble(spark, path)
    body = lambda t: (t or "").encode()
    want = []
    for i, _, t in pages:
        low = min(j for j, _, u in pages if u == t and j is not None)
        back = len(body(t)) >= 100 and i != low
        want.append((i, len(body(t)), hashlib.sha256(body(t)).hexdigest(), "revisit" if back else "response", low if back else None))
    rows = got.select("metadata.page_id", "metadata.payload_length", "capture.payload_digest", "capture.type", "capture.refers_to", "capture.payload", "capture.found_digest", "request").collect()
    found = [(r[0], r[1], r[2].removeprefix("sha256:"), r[3], int(re.search(r"response:(\d+)/", r[4])[1]) if r[4] else None) for r in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(r["found_digest"] == r[2].removeprefix("sha256:") for r in rows if r["type"] == "response")
    assert all(r["request"]["block_head"].startswith("GET ") for r in rows)
    raw = b"".join(gzip.open(f).read() for f in (tmp_path / "archive").glob("*.gz"))
    assert raw.count(b"WARC-Type: metadata") == len(pages)
    write_warc(df.filter("false"), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0


def test_patterns():
    rng = random.Random(1)
    pattern = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    for k in range(4000):
        text = "".join(rng.choice("ab@@..-+ 0123456789é(") for _ in range(rng.randint(0, 60))) + rng.choice(["", " 4111 1111 1111 1111 ", "a.b@c.d.e", "1.2.3.4.5.6.7.8"])
        want = []
        for n, (kind, p) in enumerate(pattern.items()):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
                if ok[kind]:
                    want.append((n, *m.span()))
        assert base_spans(text) == want, text


def test_disclosing_terms(spark):
    rng = random.Random(2)
    secret = [(2000 + i, f"{sentence(rng, 20)} agent Zebulon writes from zeb@mail.example.org {sentence(rng, 20)}") for i in range(5)]
    rows = ODD + texts(12, 60) + secret + [(3000, "+1 (555) 010-9999"), (3000, "+1 (555) 010-9999")]
    docs = table(spark, rows)
    got = private_spans(docs)
    assert got.count() == len(rows)
    told = {r["doc_id"]: r for r in got.withColumn("told", span_text(got["spans"])).collect()}
    assert all(told[i]["told"] == "" for i, _ in texts(12, 60))
    for i, text in secret:
        at = text.index("Zebulon")
        assert f"term:{at}:{at + 7}" in told[i]["told"] and told[i]["told"].startswith("email:")
        assert all(text[s["start"] : s["past"]].lower() in ("zebulon", "agent", "writes", "from") for s in told[i]["spans"] if s["kind"] == 4)  # nowhere else in the corpus
    clean = sanitised(docs)
    assert clean.columns == docs.columns
    new = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "[EMAIL]" in new[2000] and "[NAME]" in new[2000] and "Zebulon" not in new[2000] and new[3000] == "[PHONE]"
    assert answers(clean.filter("doc_id < 2000"), "doc_id", "text") == answers(docs.filter("doc_id < 2000"), "doc_id", "text")
    assert private_spans(docs.filter("false")).count() == 0


def test_pipeline(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELLS", 1 << 20)
    rng = random.Random(3)
    good = texts(13, 120, 120)
    item = sentence(rng, 40)
    rows = ODD + good + [(7000 + i, " ".join(w + "%%%" for w in sentence(rng, 50).split())) for i in range(8)]
    rows += [(8000, good[5][1] + " end"), (8001, sentence(rng, 30) + " " + item), (8002, "write to me@example.org " + sentence(rng, 20)), good[7]]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in good[:100]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    kept = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen[:-1]]
    assert all(df.columns == columns for df in seen[:-1])
    assert not kept[0] & {7000 + i for i in range(8)} and len(kept[0] & {i for i, _ in good}) >= 0.97 * len(good)
    assert 8000 not in kept[1] and good[5][0] in kept[1]
    assert seen[1].filter(f"doc_id = {good[7][0]}").count() == 1 and seen[1].filter("doc_id IN (3, 6)").count() == 1
    assert kept[1] - kept[2] == {8001}
    assert kept[3] == kept[2] and seen[3].filter("doc_id = 8002 AND text LIKE '%[EMAIL]%'").count() == 1
    mixed = {i for r in seen[4].collect() for i in r["doc_ids"]}
    assert mixed <= kept[3] and seen[4].count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_pipeline_of_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELLS", 1 << 20)
    docs = table(spark, ODD, more=False)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_names_rows_by_content(spark, tmp_path, monkeypatch):
    """Files that are cut otherwise when they are read again lose no other rows."""
    monkeypatch.setattr(jaccard_join, "CELLS", 1 << 20)
    rng = random.Random(4)
    good = texts(14, 120, 120)
    bad = [(7000 + i, " ".join(w + "%%%" for w in sentence(rng, 50).split())) for i in range(20)]
    same = [(9000, good[3][1] + " tail")] * 3 + [(None, sentence(rng, 30))] * 2 + [(9001, " ")] * 2
    rows = [r for pair in zip(good, bad + good[20:40] + bad + bad + bad) for r in pair] + good[100:] + same
    table(spark, rows, more=False).coalesce(1).write.option("parquet.block.size", 2048).parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    real = corpus_pipeline.stored

    def cut_anew(df, name):
        out = real(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        return out

    monkeypatch.setattr(corpus_pipeline, "stored", cut_anew)
    answer = []
    try:
        for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates):
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
            answer.append(answers(stage(spark, docs, str(tmp_path)), "doc_id", "text"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = {i for i, _ in answer[0]}
    assert not kept & {i for i, _ in bad} and len(kept & {i for i, _ in good}) >= 0.97 * len(good)
    ids = [i for i, _ in answer[1]]
    assert {i for i, _ in good + bad} <= set(ids) and max(ids.count(i) for i in set(ids) - {9001}) == 1
    assert ids.count(9001) == 2 and ids.count(None) == 1 and 9000 not in ids


def told_terms(docs, texts_of):
    """Sanitised terms of each document."""
    got = private_spans(docs).collect()
    return {r["doc_id"]: sorted({texts_of[r["doc_id"]][s["start"] : s["past"]] for s in r["spans"] if s["kind"] == 4}) for r in got if r["doc_id"] in texts_of}


def test_distant_terms_disclose_and_rare_ones_do_not(spark):
    """Names far from a value are caught from three texts on; words of one text, or of a text and its copies, never."""
    rng = random.Random(5)
    invented = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    planted = [f"{invented().title()}son" for _ in range(20)]
    people = [(10_000 + 10 * p + i, f"{name} {sentence(rng, 60)} p{p}@mail.example.org {sentence(rng, 20)} {invented()}") for p, name in enumerate(planted) for i in range(3)]
    once = [(20_000 + i, f"{invented()} {sentence(rng, 40)} 10.20.30.{i} {sentence(rng, 20)} {invented()}") for i in range(100)]
    copies = [(30_000 + i, t) for i, (_, t) in enumerate(once[:30] * 6)]
    near = [(40_000 + 10 * i + k, f"{t} {WORDS[k]}") for i, (_, t) in enumerate(once[30:60]) for k in range(6)]
    some = dict(people + once + copies + near)
    verdicts = []
    for others in (300, 3000):  # the same counts have the same verdict in a corpus of any size
        told = told_terms(table(spark, ODD + texts(15, others, 20) + list(some.items())), some)
        caught = sum(name in told[10_000 + 10 * p + i] for p, name in enumerate(planted) for i in range(3))
        rare = sum(len(told[i]) for i in told if i >= 20_000) + sum(len(set(told[i]) - set(planted)) for i in told if i < 20_000)
        assert caught >= 0.9 * 60 and rare < 0.01 * sum(len(set(t.split())) for t in some.values()), (caught, rare)
        assert not any(told[i] for i in told if i >= 20_000)
        verdicts.append(told)
    assert verdicts[0] == verdicts[1]


def test_exceptions_weigh_less_among_more_cases(spark):
    """Brute force over counts: the lower bound of the share of a term's texts that have the value."""
    rng = random.Random(6)
    rows, want = [], {}
    for k, (cases, other) in enumerate([(2, 0), (3, 0), (4, 1), (9, 1), (5, 5), (30, 9)]):
        name = f"name{'abcdef'[k]}"
        for i in range(cases + other):
            rows.append((1000 * (k + 1) + i, f"{sentence(rng, 12)} {name} {sentence(rng, 12)} {f'v{k}@mail.example.org' if i < cases else ''}"))
        n, p, z = cases + other, cases / (cases + other), 1.645
        low = (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)
        want |= {1000 * (k + 1) + i: [name] if low >= 0.5 and i < cases else [] for i in range(cases + other)}
    some = dict(rows)
    assert told_terms(table(spark, texts(16, 600, 20) + rows), some) == want
    assert sorted({i // 1000 for i in want if want[i]}) == [2, 4, 6]
