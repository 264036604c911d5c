"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Every rule votes good (1), bad (-1) or abstains (0) on a document, from
counts that one pass over the whole text gives.  Expectation-maximisation over
the vote patterns estimates two accuracies of each rule - how often its vote
is right on good documents and on bad ones, when it votes - and how many
documents are good; a document's posterior probability of being good decides,
instead of the demand that it pass every rule.  A rule that accuses good and
bad documents alike gets a weight near 0, whatever it was meant to find.  All
of it is DataFrame expressions: patterns are counted with the data (at most
3**rules of them), and each EM step is one aggregation over the patterns.

``base_failed`` is a fixed floor beside the votes: fewer than 50 words, or
more than half of the words in repeated 3-word windows.

Nulls: a null text has no words; a null doc_id stays.  Repeated rows get equal
verdicts.  Empty texts are base_failed.  Texts of any length are used whole.
Other columns are ignored by the query.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

_SPACES = "\t\n\u000b\f\r "
_SYMBOLS = "#*$%&|<>"
#: EM steps at most, and the change of any estimate at which it stops.
EM_STEPS, EM_CHANGE = 100, 1e-4


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides."""
    text = F.col("_text")
    count = lambda chars: (F.length(text) - F.length(_without(text, chars))).cast("bigint")
    spaced = text
    for c in _SPACES[:-1]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    df = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", F.array_remove(F.split(spaced, " "), ""))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(_without(text, _SPACES)).cast("bigint"),
            "n_symbols": count(_SYMBOLS),
            "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != ""),
            "n_shouts": count("!?"),
            "n_upper": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("bigint"),
            "n_digits": count("0123456789"),
            "n_stops": count(".,;:"),
        }
    )
    # Hash of each 3-word window; a window is repeated if its hash is there more than once.
    df = df.withColumn("_hashes", F.when(F.col("n_words") >= 3, F.expr("transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2]))")).otherwise(F.expr("cast(array() as array<bigint>)")))
    df = df.withColumns({"n_lines": F.size("_lines").cast("bigint"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"), "n_distinct_words": F.size(F.array_distinct("_words")).cast("bigint")})
    # Windows in the order of their hashes: equal ones are neighbours.
    df = df.withColumn("_windows", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.expr("array_sort(transform(_hashes, (h, i) -> named_struct('h', h, 'i', i)))")))
    df = df.withColumn("_again", F.expr("sort_array(transform(filter(_windows, (w, k) -> coalesce(w.h = get(_windows, k - 1).h, false) or coalesce(w.h = get(_windows, k + 1).h, false)), w -> w.i))"))
    # From each repeated window the words up to the next one, three at most.
    df = df.withColumn("n_repeat_words", F.coalesce(F.expr("aggregate(transform(_again, (x, k) -> least(3, coalesce(get(_again, k + 1), x + 3) - x)), 0, (a, x) -> a + x)"), F.lit(0)).cast("bigint"))
    return df.drop("_text", "_words", "_lines", "_hashes", "_windows", "_again")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """Rules over the columns of ``with_counts``; ratios are written as products, a text without words votes bad."""
    c = F.col
    return {
        "word_count": _vote(c("n_words") >= 80, c("n_words") < 50),
        "word_length": _vote(c("word_chars").between(3 * c("n_words"), 10 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        "symbols": _vote(c("n_symbols") * 100 <= c("n_words"), c("n_symbols") * 10 > c("n_words")),
        "duplicate_lines": _vote(c("n_dup_lines") == 0, c("n_dup_lines") * 10 > 3 * c("n_lines")),
        "repeated_words": _vote(c("n_repeat_words") * 10 <= c("n_words"), c("n_repeat_words") * 10 > 3 * c("n_words")),
        "variety": _vote(c("n_distinct_words") * 3 >= c("n_words"), c("n_distinct_words") * 10 < c("n_words")),
        "shouting": _vote(c("n_shouts") * 20 <= c("n_words"), c("n_shouts") * 4 > c("n_words")),
        "capitals": _vote(c("n_upper") * 10 <= c("word_chars"), c("n_upper") * 2 > c("word_chars")),
        "digits": _vote(c("n_digits") * 20 <= c("word_chars"), c("n_digits") * 4 > c("word_chars")),
        # Characters of words that are none of the signs counted here: letters, for the most part.
        "letters": _vote((c("n_symbols") + c("n_digits") + c("n_stops") + c("n_shouts")) * 20 <= c("word_chars"), ((c("n_symbols") + c("n_digits") + c("n_stops") + c("n_shouts")) * 10 > c("word_chars")) | (c("n_words") == 0)),
        "sentences": _vote((c("n_stops") > 0) & (c("n_stops") * 60 >= c("n_words")), (c("n_words") >= 100) & (c("n_stops") * 200 < c("n_words"))),
    }


Accuracies = dict[str, tuple[float, float]]


def posterior(accuracies: Accuracies, prior: float) -> Column:
    """Probability of good given the vote columns; ``accuracies[rule]`` is how often it is right on (bad, good) documents."""
    logit = F.lit(math.log(prior / (1 - prior)))
    for name, (bad, good) in accuracies.items():
        logit = logit + F.when(F.col(name) > 0, math.log(good / (1 - bad))).when(F.col(name) < 0, math.log((1 - good) / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


#: Votes that every estimate starts with, and how many of them are right on bad and on good documents.
_PSEUDO, _PSEUDO_RIGHT = 10, (0.3, 0.9)


def estimate(patterns: DataFrame, rules: list[str], steps: int = EM_STEPS) -> tuple[Accuracies, float]:
    """(accuracies of each rule, share of good documents).

    ``patterns`` has the vote columns and n.  In the first step every bad vote
    halves a pattern's probability of being good.  Afterwards the side is called
    good on which the rules are right more often than wrong, all told; no other
    constraint holds.
    """
    accusing = sum((F.when(F.col(r) == -1, 1).otherwise(0) for r in rules), F.lit(0))
    p, before = 0.95 * F.pow(F.lit(0.5), accusing), None
    accuracies, prior = {r: (_PSEUDO_RIGHT[0], _PSEUDO_RIGHT[1]) for r in rules}, 0.5
    for _ in range(steps):
        sums = [F.sum(F.col("n") * F.col("p")).alias("good"), F.sum("n").alias("all")]
        for r in rules:
            for v in (-1, 1):
                n = F.when(F.col(r) == v, F.col("n")).otherwise(0)
                sums += [F.sum(n * (1 - F.col("p"))).alias(f"{r}:{v}:0"), F.sum(n * F.col("p")).alias(f"{r}:{v}:1")]
        found = patterns.withColumn("p", p).agg(*sums).first()
        if not found["all"]:
            break
        right = lambda r, y: (found[f"{r}:{(-1, 1)[y]}:{y}"] + _PSEUDO * _PSEUDO_RIGHT[y]) / (found[f"{r}:-1:{y}"] + found[f"{r}:1:{y}"] + _PSEUDO)  # noqa: B023, E731
        accuracies = {r: (right(r, 0), right(r, 1)) for r in rules}
        prior = min(0.999, max(0.001, found["good"] / found["all"]))
        now = [prior, *(x for pair in accuracies.values() for x in pair)]
        if before and max(abs(x - y) for x, y in zip(now, before, strict=True)) < EM_CHANGE:
            break
        p, before = posterior(accuracies, prior), now
    if sum(bad + good - 1 for bad, good in accuracies.values()) < 0:
        accuracies, prior = {r: (1 - good, 1 - bad) for r, (bad, good) in accuracies.items()}, 1 - prior
    return accuracies, prior


def judge(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, the counts, base_failed, the votes, quality (posterior) and kept of each row."""
    rules = rule_votes()
    counted = with_counts(docs.select(F.col("doc_id").cast("bigint"), "text")).drop("text")
    voted = scratch.keep(counted.withColumns(rules), "votes")
    # At most 3 ** rules rows, however many documents.
    patterns = scratch.keep(voted.groupBy(*rules).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    accuracies, prior = estimate(patterns, list(rules))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("base_failed", base).withColumn("quality", posterior(accuracies, prior)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, Scratch(spark, "quality-rules")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
