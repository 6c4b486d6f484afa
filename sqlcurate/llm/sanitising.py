"""Personal data: patterns, and terms that give the found values away.

Patterns find e-mail, network, card and phone values. Corpus co-occurrence then tells which terms disclose a value, by
counts over whole documents of the whole corpus. A term discloses a value if the chance of the value, given the term,
is at least `DISCLOSURE` with confidence: the lower end of Wilson's interval, so that one or two cases prove nothing
and an exception weighs the less the more cases there are. What is left unknown of the value is then -log2(DISCLOSURE)
bits at most, a bound that does not move with the size of the corpus. The mutual information must be positive by at
least GAIN bits as well, so that words of every document disclose no value that most documents have.

Copies of a text, exact or near, are one case: texts that agree in a band of smallest hashes of their five-word
shingles, and those that such agreements reach.

Terms are sanitised wherever they stand in a document with the value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sqlcurate.llm.components import components
from sqlcurate.llm.key_filters import flagged
from sqlcurate.llm.lookup import bits_at
from sqlcurate.llm.rows import boxed, named
from sqlcurate.llm.words import SPACE_AND_MARKS, U64, chain, mix, rolling, utf8, words_of
from sqlcurate.llm.workers import giving_back, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Least chance of a value given a term that discloses it, the z of its lower bound (95 %, one-sided), and bits gained.
DISCLOSURE, CONFIDENCE, GAIN = 0.5, 1.645, 1.0
#: Letters and digits that a term has at least; words of a shingle.
TERM_LENGTH, SHINGLE = 3, 5
#: Bands of a sketch and hashes in each: texts that share 0.8 of their shingles meet with 0.985, 0.1 with 0.001.
BANDS, WIDTH = 8, 4
ORDERS = mix(np.arange(1, BANDS * WIDTH + 1, dtype=U64))
FILTER_BITS = 1 << 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that fails at its first digit fails at all others.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, in one pass: the local part is all that fits before an @."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at)):
            past = found.end()
            yield start, past
        at = text.find("@", max(at + 1, past))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, past) in code points, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = "".join(DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def value_hash(kind: int, value: str) -> int:
    """Equal for equal values, however their digits are grouped."""
    plain = value.lower() if kind < 2 else "".join(DIGIT.findall(value))
    data = np.frombuffer(f"{kind}:{plain}".encode(), np.uint8)
    return int(chain(mix(data.astype(U64) * U64(0x9E3779B97F4A7C15) + np.arange(len(data), dtype=U64)).sum()[None]).view(np.int64)[0])


def sketch_of(hashes: np.ndarray) -> list[int]:
    """A hash for each band of a text's sketch; a text of fewer words than a shingle has is one shingle."""
    if len(hashes) < SHINGLE:
        hashes = np.append(hashes, U64(len(hashes)))
    shingles = rolling(hashes, min(SHINGLE, len(hashes)))
    least = np.array([mix(shingles ^ order).min() for order in ORDERS]).reshape(BANDS, WIDTH)
    return chain(np.arange(BANDS, dtype=U64), *least.T).view(np.int64).tolist()


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[dict], list[int]]:
    """Terms of a text (term, start, past) and its sketch. A term that overlaps a value is none."""
    data = np.frombuffer(text.encode(), np.uint8)
    place = np.cumsum((data & 0xC0) != 0x80)  # code points up to and including a byte
    (words,) = words_of(data, np.array([0, len(data)]), between=SPACE_AND_MARKS)
    start, past = place[words.start] - 1, place[words.end - 1]
    free = past - start >= TERM_LENGTH
    for _, a, b in spans:
        free[np.searchsorted(past, a, "right") : np.searchsorted(start, b)] = False
    hashes = words.hash.view(np.int64)
    terms = [{"term": t, "start": a, "past": b} for t, a, b in zip(hashes[free].tolist(), start[free].tolist(), past[free].tolist(), strict=True)]
    return terms, sketch_of(words.hash)


def searched(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per row: id, hash (of the text), spans, entities, and terms and sketch (of a text with values)."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("past", pa.int32())]))
    term = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("past", pa.int32())]))

    @giving_back
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans, entities, terms, sketches = [], [], [], []
            for text in part.column(2):
                text = text.as_py() or ""
                found = base_spans(text)
                spans.append([{"kind": k, "start": a, "past": b} for k, a, b in found])
                entities.append(sorted({value_hash(k, text[a:b]) for k, a, b in found}))
                own = free_terms(text, found) if found else ([], [])
                terms.append(own[0])
                sketches.append(own[1])
            longs = pa.list_(pa.int64())
            columns = [pa.array(spans, span), pa.array(entities, longs), pa.array(terms, term), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], ["id", "hash", "spans", "entities", "terms", "sketch"])

    text = F.col(f"`{text_column}`")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return rows.mapInArrow(
        batches, f"id {dict(rows.dtypes)['id']}, hash bigint, spans array<struct<kind:int,start:int,past:int>>, "
        "entities array<bigint>, terms array<struct<term:bigint,start:int,past:int>>, sketch array<bigint>",
    )


def document_counts(docs: DataFrame, text_column: str, terms: DataFrame) -> DataFrame:
    """(term, n_term): documents with each of the terms, over all documents. The filter is of fixed size."""
    at = F.col("term").bitwiseAND(FILTER_BITS - 1)
    longs = terms.groupBy(F.shiftright(at, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(term & 63 AS int)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in longs.toLocalIterator():
        table[r["at"]] = r["bits"]
    packed = table.view(np.uint8)

    @giving_back
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.empty(0, U64), np.empty(0, np.int64)  # of the whole task
        for part in parts:
            found = [total]
            for words in words_of(*utf8(part.column(0)), between=SPACE_AND_MARKS):
                hit = np.flatnonzero(bits_at(packed, (words.hash & U64(FILTER_BITS - 1)).astype(np.int64)))
                order = np.lexsort((words.row[hit], words.hash[hit]))
                term, row = words.hash[hit][order], words.row[hit][order]
                found.append(term[np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])[: len(term)]])
            weights = np.concatenate([counts, np.ones(sum(map(len, found[1:])), np.int64)])
            total, at = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(at, weights, len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64)), pa.array(counts)], ["term", "n"])

    made = docs.select(F.col(f"`{text_column}`").alias("text")).mapInArrow(batches, "term bigint, n bigint")
    return made.groupBy("term").agg(F.sum("n").alias("n_term"))


def surely(both: Column, other: Column) -> Column:
    """Lower bound of the chance of a value, from texts of a term with it and without it."""
    n, z = both + other, CONFIDENCE
    share = both / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def cases_among(held: DataFrame) -> DataFrame:
    """(doc, case): equal cases for texts that are copies of one another."""
    bands = held.select("doc", F.explode("sketch").alias("band")).distinct()
    leads = bands.groupBy("band").agg(F.min("doc").alias("lead"))
    links = bands.join(leads, "band").filter("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b")).distinct()
    roots = components(stored(links, "copies")).select(F.col("node").alias("doc"), "root")
    case = F.coalesce("root", "doc").alias("case")
    return stored(held.select("doc").distinct().join(roots, "doc", "left").select("doc", case), "cases")


def disclosing(docs: DataFrame, found: DataFrame, text_column: str, threshold: float) -> DataFrame:
    """(doc, given): by key of a text with values, the terms in it that give one of them away.

    Values that occur in the same texts are one class, and so are terms that do and are as frequent: all pairs of two
    classes have the same counts, so a text full of values and terms makes few pairs. Values and terms with too few
    cases for any verdict are no part of pairs; the bound is the same function of counts that decides in the end.
    """
    held = found.filter("size(spans) > 0").select(F.xxhash64("id", "hash").alias("doc"), "entities", F.array_distinct("terms.term").alias("terms"), "sketch")
    cases_of = cases_among(held)
    values = held.select("doc", F.explode("entities").alias("entity")).groupBy("doc", "entity").agg(F.count("*").alias("n"))
    values = stored(values.join(cases_of, "doc"), "values")
    terms = held.select("doc", F.explode("terms").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n"))
    terms = stored(terms.join(cases_of, "doc"), "terms")
    where = F.bit_xor(F.xxhash64("doc")).alias("where")
    cases = F.count_distinct("case").alias("cases")
    sure = surely(F.col("cases"), F.lit(0)) >= threshold
    value = values.groupBy("entity").agg(F.sum("n").alias("n_value"), cases, where).filter(sure)
    term = terms.groupBy("term").agg(F.sum("n").alias("n_in"), cases, where).filter(sure)
    term = stored(term.withColumnRenamed("cases", "t_cases"), "known_terms")
    term = term.join(document_counts(docs, text_column, term.select("term")), "term")
    term = term.filter(surely(F.col("t_cases"), F.col("n_term") - F.col("n_in")) >= threshold)
    value = value.withColumnRenamed("cases", "v_cases").withColumn("ec", F.xxhash64("where", "n_value"))
    left = values.join(value, "entity").select("doc", "ec", "n", "n_value", "v_cases", "case").distinct()
    term = term.withColumn("tc", F.xxhash64("where", "n_in", "n_term"))
    placed = stored(terms.join(term, "term").select("doc", "term", "tc", "n_in", "n_term", "t_cases"), "placed")

    total = F.lit(float(found.count()))

    def discloses(cases: Column, together: Column) -> Column:
        chance = surely(cases, F.greatest(F.col("n_term") - together, F.lit(0)))
        return (chance >= threshold) & (F.log2(chance * total / F.col("n_value")) >= GAIN)

    met = left.join(placed.drop("term").distinct(), "doc").filter(discloses(F.least("t_cases", "v_cases"), F.least("n_in", "n_value")))
    met = stored(met.select("doc", "ec", "tc", "n", "n_value", "n_term", "case"), "together")
    classes = ["ec", "tc", "n_value", "n_term"]
    both = met.groupBy(*classes).agg(F.count_distinct("case").alias("cases"), F.sum("n").alias("n_both"))
    given = met.join(both.filter(discloses(F.col("cases"), F.col("n_both"))), ["ec", "tc"]).select("doc", "tc").distinct()
    return placed.join(given, ["doc", "tc"]).groupBy("doc").agg(F.collect_set("term").alias("given"))  # within one text


def term_spans(rows: DataFrame) -> DataFrame:
    """(of, of_hash, added) from (of, of_hash, terms, given): spans of the given terms, by start."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("past", pa.int32())]))

    @giving_back
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans = []
            for terms, given in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                given = set(given)
                spans.append([{"kind": 4, "start": x["start"], "past": x["past"]} for x in terms if x["term"] in given])
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(spans, span)], ["of", "of_hash", "added"])

    return rows.mapInArrow(batches, f"of {dict(rows.dtypes)['of']}, of_hash bigint, added array<struct<kind:int,start:int,past:int>>")


def private_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = DISCLOSURE) -> DataFrame:
    """Per row: id, text_hash, base (spans of the patterns) and spans (base, and terms as kind 4), by kind and start.

    A span is (kind, start, past) in code points; kinds are places in KINDS. A null or empty text has none. Rows
    that repeat get the same spans each; other columns are not read. Without values no term is sanitised. An empty
    table gives an empty result.
    """
    found = stored(searched(docs, id_column, text_column), "private")
    given = disclosing(docs, found, text_column, threshold)
    held = found.filter("size(spans) > 0").select("id", "hash", "terms", F.xxhash64("id", "hash").alias("doc"))
    held = held.join(given, "doc").select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "terms", "given")
    added = term_spans(held).dropDuplicates(["of", "of_hash"])
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash"))
    out = found.select("id", "hash", F.col("spans").alias("base")).join(added, same, "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    return out.select(F.col("id").alias(id_column), F.col("hash").alias("text_hash"), "base", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:past, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["past"].cast("string"))), ",")


def sanitised(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with the text's spans replaced: a value by its kind in brackets, a disclosing term by its shape.

    Overlapping spans are replaced as one, by the kind that comes first. All columns and rows are kept.
    """
    found = private_spans(docs, id_column, text_column).filter("size(spans) > 0")
    found = found.select(named(id_column).alias("of"), F.col("text_hash").alias("of_hash"), "spans").dropDuplicates(["of", "of_hash"])
    found = stored(found, "found")

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return texts.combine(spans, replace_spans)

    rows = boxed(docs, id=named(id_column), hash=F.xxhash64(named(text_column)), text=named(text_column))
    rows = flagged(rows, found.select("of", "of_hash"), ["id", "hash"])  # few texts have spans; the others join nothing
    joined = rows.filter("_maybe").join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    new = F.when(F.col("spans").isNotNull(), replaced(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    changed = joined.select(*[new.alias(c) if c == text_column else F.col(f"doc.`{c}`") for c in docs.columns])
    return rows.filter("NOT _maybe").select("doc.*").unionByName(changed)


def replace_spans(text: str | None, spans: object) -> str | None:
    if text is None or spans is None:
        return text
    out, at = [], 0
    for start, past, kind in sorted((s["start"], s["past"], s["kind"]) for s in spans):
        if start >= at:
            out += [text[at:start], generalised(text[start:past]) if kind == 4 else f"[{KINDS[kind].upper()}]"]
        at = max(at, past)
    return "".join([*out, text[at:]])


def generalised(term: str) -> str:
    """What is left of a term: that it is a number, a name or a word."""
    return "[NUMBER]" if DIGIT.search(term) else "[NAME]" if term[:1].isupper() else "[WORD]"
