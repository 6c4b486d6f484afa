"""Quality rules as weak supervision, in built-in expressions only.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns
estimates how often each rule is right; a document is kept if its posterior probability of being good reaches
the threshold. There are at most 3^rules patterns, so the step that fits the
model sees a table of fixed size, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlcurate.sources.storage import stored

SPACES = r"[\x20\x09-\x0D]+"
#: A document fails at once with fewer words, or with a larger share of words in repeated five-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: rule -> (votes bad if, votes good if); where neither holds, or a value is null, it abstains. Distinct words grow with
#: the root of a long text's length; the root of 20 n meets a tenth of n at 2000 words.
RULES = {
    "symbols": ("n_symbols > 0.3 * n_words", "false"),
    "repeated_windows": ("n_repeat_words > 0.1 * n_words", "false"),
    "repeated_lines": ("n_dup_lines > 0.3 * n_lines", "false"),
    "word_length": ("word_chars NOT BETWEEN 2.5 * n_words AND 12 * n_words", "false"),
    "capitals": ("n_capitals > 0.4 * word_chars", "false"),
    "letters": ("n_lettered < 0.7 * n_words", "false"),
    "shouts": ("n_exclaimed > 0.3 * n_words", "false"),
    "prose": ("false", "n_symbols <= 0.02 * n_words AND n_lettered >= 0.95 * n_words AND n_capitals < 0.2 * word_chars"),
    "measured": ("false", "word_chars BETWEEN 3 * n_words AND 9 * n_words AND n_exclaimed <= 0.02 * n_words AND n_symbols <= 0.02 * n_words"),
    "varied": ("n_distinct < least(0.1 * n_words, sqrt(20.0 * n_words))",
               "n_distinct >= 0.3 * n_words AND n_repeat_words = 0 AND n_symbols <= 0.02 * n_words AND n_capitals < 0.2 * word_chars"),
}
#: EM starts from, and for rules that hardly vote stays near, FIRST_ACCURACY, as if seen on PRIOR_VOTES votes.
ITERATIONS, FIRST_ACCURACY, PRIOR_VOTES, THRESHOLD = 40, 0.8, 5, 0.5


def let(value: Column, then) -> Column:
    """`then(value)` with the value computed once for the row, although a lambda uses it often."""
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a window of WINDOW words which the text has twice or more."""

    def repeats(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(ordered, positions), covered)).otherwise(0)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) < WINDOW, 0).otherwise(let(let(words, windows), repeats))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What the rules look at, per row. A null text has no words; an id may be null or repeat."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    words = F.array_remove(F.split("text", SPACES), "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parted = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text")).select("id", "text", words.alias("words"), lines.alias("lines"))
    base = parted.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_lettered"),
        F.regexp_count("text", F.lit(r"!")).cast("long").alias("n_exclaimed"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def votes() -> Column:
    """Votes of all rules as an array, in the order of RULES."""
    return F.array(*[F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for bad, good in RULES.values()])


def posteriors(patterns: DataFrame) -> DataFrame:
    """(votes, p_good) from (votes, n) by expectation-maximisation.

    A rule that votes is right with its own accuracy, whatever the class; an abstention says nothing, and before
    any vote both classes are as likely, so a document without votes has 0.5. Patterns are distinct, hence at most
    3^rules rows; they are put in order, so a rerun gives the same figures. An empty table gives an empty one.
    """
    log_odds = lambda a: F.log(a / (1 - a))

    def expected(rows: Column, strengths: Column) -> Column:
        """Rows with the probability of being good under rules of these strengths (log odds of being right)."""

        def of(x: Column) -> Column:
            total = F.aggregate(F.zip_with(x["v"], strengths, lambda v, s: v * s), F.lit(0.0), lambda a, b: a + b)
            return F.struct(x["v"].alias("v"), x["n"].alias("n"), (1 / (1 + F.exp(-total))).alias("good"))

        return F.transform(rows, of)

    def strengths(rows: Column) -> Column:
        """Of each rule, from the rows' probabilities."""

        def of(j: Column) -> Column:
            def add(a: Column, x: Column) -> Column:
                v = F.get(x["v"], j)
                right = F.when(v == 1, x["good"]).when(v == -1, 1 - x["good"]).otherwise(0.0)
                return F.struct((a["right"] + x["n"] * right).alias("right"), (a["all"] + x["n"] * F.abs(v)).alias("all"))

            start = F.struct(F.lit(FIRST_ACCURACY * PRIOR_VOTES).alias("right"), F.lit(float(PRIOR_VOTES)).alias("all"))
            return F.aggregate(rows, start, add, lambda a: log_odds(F.least(a["right"] / a["all"], F.lit(0.999))))

        return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), of)

    gathered = patterns.agg(
        F.array_sort(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n"), F.lit(0.5).alias("good")))).alias("p")
    )
    first = expected(F.col("p"), F.array_repeat(log_odds(F.lit(FIRST_ACCURACY)), len(RULES)))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), first, lambda rows, _: let(strengths(rows), lambda s: expected(rows, s)))
    return gathered.select(F.explode(rounds).alias("x")).select(F.col("x.v").alias("votes"), F.col("x.good").alias("p_good"))


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Features, votes, p_good and kept per row of `docs`.

    Rows are judged each, also when ids repeat or are null; further columns are not read. A null or empty text
    has no words and fails. Ties at the threshold are kept. An empty table gives an empty result. The features
    are written once to the shared folder, because both the model and the verdicts need them.
    """
    seen = stored(features(docs, id_column, text_column).withColumn("votes", votes()), "quality")
    fitted = posteriors(seen.groupBy("votes").agg(F.count("*").alias("n")))
    judged = seen.join(F.broadcast(fitted), "votes")  # at most 3^rules rows
    kept = ~F.col("base_failed") & (F.col("p_good") >= threshold)
    return judged.select(F.col("id").alias(id_column), *[c for c in seen.columns if c not in ("id", "votes")], "votes", "p_good", kept.alias("kept"))
