import random
import re
import time
from collections import Counter

import public_tokenizers
import sentencepiece
from cases import ODD, answers, table, texts

from sqlcurate.llm.quality_rules import judge_quality
from sqlcurate.llm.token_counts import MergeTable, count_tokens, pre_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def test_counts_are_those_of_the_library():
    rng, processor, merges = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=MODEL), MergeTable(MODEL)
    some = ["".join(rng.choice("aeinorst  \nthé▁🙂ABßch.") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    some += ["a" * 999, " " * 333 + "x" + " " * 77, "<s> </s> <unk> <0x0A>", "\x00\r\n\t▁▁ ▁", "ab" * 2000]
    for text in some:
        words = pre_tokens(text)
        assert sum(merges.count(words).tolist() if words else []) == len(processor.encode(text)), repr(text[:40])


def test_long_text_without_spaces():
    """Merges from a queue are those of the library, in time that hardly grows faster than the text."""
    rng, processor, merges = random.Random(8), sentencepiece.SentencePieceProcessor(model_file=MODEL), MergeTable(MODEL)
    some = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "aeinorst", "thé🙂▁Bß中文字", "a") for n in (257, 2000, 20_001)]
    for text in some:
        assert sum(merges.count(pre_tokens(text)).tolist()) == len(processor.encode(text)), text[:40]
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    start = time.perf_counter()
    assert sum(merges.count(pre_tokens(text)).tolist()) == len(processor.encode(text))
    assert time.perf_counter() - start < 10


def test_count_tokens(spark):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = ODD + texts(1, 30) + [(77, "word " * 6000)]
    got = count_tokens(table(spark, rows), MODEL)
    want = [(i, len((t or "").encode()), n := len(processor.encode(t or "")), n > 4096) for i, t in rows]
    assert answers(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert count_tokens(table(spark, rows).filter("false"), MODEL).count() == 0


def brute(text):
    text = text or ""
    words = PATTERN.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered, lines, again = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    for line in text.split("\n"):
        if PATTERN.search(line):
            again += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rules(spark):
    rng = random.Random(5)
    rows = ODD + texts(2, 120)
    rows += [(300 + i, " ".join(w + "###" for w in t.split())) for i, (_, t) in enumerate(texts(3, 15))]
    rows += [(400 + i, "\n".join(rng.choice(["same line again", "x y", "", "other & line"]) for _ in range(20))) for i in range(5)]
    rows += [(500, " ".join(str(k) for k in range(20000))), (501, "a b c d e a b c d e f a b c d e")]
    judged = judge_quality(table(spark, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert answers(judged, "doc_id", *names) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in judged.collect()}
    assert not any(kept[300 + i][0] for i in range(15))  # every word carries symbols
    assert all(kept[i][0] for i, _ in texts(2, 120) if not kept[i][1])
    assert judge_quality(table(spark, rows).filter("false")).count() == 0


def test_quality_rules_run_no_python(spark):
    plan = judge_quality(table(spark, ODD))._jdf.queryExecution().toString()
    assert not [n for n in ("Python", "Pandas", "Arrow") if n in plan]


def test_vocabulary_of_long_texts(spark):
    """A text drawn from 30 words is no more varied with 2,500 words than with 1,900; a long text of many words is."""
    rng = random.Random(6)
    few, many = [f"word{'abcdefghij'[k % 10]}{'xyz'[k // 10]}" for k in range(30)], [f"w{k}ord" for k in range(3000)]
    rows = [(1, " ".join(rng.choices(few, k=1900))), (2, " ".join(rng.choices(few, k=2500))), (3, " ".join(rng.choices(few, k=60000))), (4, " ".join(rng.choices(many, k=40000)))]
    got = {r["doc_id"]: r["votes"][-1] for r in judge_quality(table(spark, rows)).collect()}
    assert got[1] == got[2] == got[3] == -1 and got[4] != -1
