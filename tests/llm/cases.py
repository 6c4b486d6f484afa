"""Small tables with awkward rows, shared by the tests of the operators."""

import random

WORDS = "the of and river stone small walks under light winter garden paper cold bright seven houses".split()
#: Null, empty and blank texts, ties, rows that repeat, one very long text.
ODD = [(None, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (4, "One two"), (None, "no id here"), (5, "a b c d e"), (6, "A B C D E")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ly"]) for _ in range(n))


def texts(seed: int, n: int, size: int = 60) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    return [(i, sentence(rng, rng.randint(3, size))) for i in range(100, 100 + n)]


def table(spark, rows, more: bool = True):
    """doc_id, text, lang, source, n_chars; with `more`, columns named like those that operators make."""
    df = spark.createDataFrame([(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None) for k, (i, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string").repartition(3)
    df = df.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) AS n_chars")
    if more:
        names = ["id", "hash", "words", "row", "set", "size", "token", "start", "of", "doc", "kept", "score", "votes", "spans", "block", "target", "__id"]
        df = df.selectExpr("*", *[f"'x' AS `{n}`" for n in names])
    return df


def answers(df, *columns):
    """Rows as sortable tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
