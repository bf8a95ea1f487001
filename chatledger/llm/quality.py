"""Quality rules by weak supervision.

Every rule reads counts of one document and votes good (1), bad (-1) or abstains (0). How far a rule can be
trusted is not set by hand: expectation-maximisation estimates, from how the rules agree over all documents, how
often each of them votes which way on good and on bad text. A document is kept by its posterior probability of
being good, not because it passes every rule.

Everything is DataFrame work. The rows of EM are the distinct vote patterns with their counts (at most 3 to the
number of rules); each round is one aggregate of that table into one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import cut_lineage, words

VOTES = (-1, 0, 1)
#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED = 50, 50


def counts(documents: DataFrame) -> DataFrame:
    """What the rules read, per document. A null text counts as empty; repeated rows stay apart.

    ``n_repeat_words`` marks every word of a three-word window found at least twice. Windows are compared by a
    64-bit hash within one document, so texts of a million words are told apart with a risk of about 1e-8.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select("doc_id", text.alias("text"), words("text").alias("w"))
    split = split.withColumn("n", F.size("w"))
    word = lambda i: F.get("w", i)
    windows = F.when(F.col("n") >= 3, F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("i")),
    ))
    hashed = split.withColumn("windows", F.array_sort(windows)).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    )
    here = lambda k: F.get("windows", k)["h"]
    same = lambda x, k: x["h"].eqNullSafe(F.when(k > 0, here(k - 1))) | x["h"].eqNullSafe(here(k + 1))
    repeats = hashed.withColumn("repeats", F.filter("windows", same))
    covered = F.flatten(F.transform("repeats", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    length = lambda c: F.char_length(c)
    kept = lambda chars: length("text") - length(F.translate("text", chars, ""))
    return repeats.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        kept("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") < 3, 0).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        kept(".,;:?").cast("long").alias("n_marks"), kept("!").cast("long").alias("n_bangs"),
        (length("text") - length(F.regexp_replace("text", "\\p{Lu}", ""))).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    """The base rule: too few words, or most of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The votes, by name. A rule about one kind of damage votes bad or abstains: its absence proves little. Shares are of words, of lines or of characters in words; an empty text has none and
    every rule but the first abstains on it."""
    share = lambda part, whole: F.col(part) / F.nullif(F.col(whole), F.lit(0))

    def vote(value: Column, good: Callable | None, bad: Callable) -> Column:
        voted = F.when(bad(value), -1)
        return F.coalesce(voted.when(good(value), 1) if good else voted, F.lit(0))

    return {
        "length": vote(F.col("n_words"), lambda x: x >= 2 * LEAST_WORDS, lambda x: x < LEAST_WORDS),
        "word_length": vote(
            share("word_chars", "n_words"), lambda x: x.between(3, 12), lambda x: (x < 2) | (x > 20)),
        "symbols": vote(share("n_symbols", "n_words"), None, lambda x: x > 0.1),
        "symbol_chars": vote(share("n_symbols", "word_chars"), None, lambda x: x > 0.03),
        "lines": vote(share("n_dup_lines", "n_lines"), None, lambda x: x > 0.5),
        "repeats": vote(share("n_repeat_words", "n_words"), None, lambda x: x > 0.3),
        "variety": vote(share("n_distinct_words", "n_words"), lambda x: x > 0.2, lambda x: x < 0.1),
        "marks": vote(share("n_marks", "n_words"), lambda x: x.between(0.02, 0.6), lambda x: (x == 0) | (x > 1)),
        "shouts": vote(share("n_bangs", "n_words"), None, lambda x: x > 0.3),
        "upper": vote(share("n_upper", "word_chars"), None, lambda x: x > 0.5),
    }


def _logit(names: list[str], model: dict) -> Column:
    """The log odds of good text given the votes, as an expression of literals."""
    prior = F.lit(log(model["good"]) - log(1 - model["good"]))

    def of(name: str) -> Column:
        ratio = [log(model[name, v, 1]) - log(model[name, v, 0]) for v in VOTES]
        return F.element_at(F.array(*map(F.lit, ratio)), (F.col(name) + 2).cast("int"))

    return reduce(lambda a, b: a + b, map(of, names), prior)


def estimate(votes: DataFrame, names: list[str], rounds: int = 15) -> dict:
    """EM over the vote patterns: the share of good text, and per rule the chance of each vote on good (1) and on
    bad (0) text. Starts by doubting text with any bad vote, which also fixes which class is the good one; one vote
    of each kind is added as a prior, so an empty table gives even chances."""
    patterns = cut_lineage(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    good = F.when(F.least(*names) < 0, 0.2).otherwise(0.9)
    for _ in range(rounds):
        weighed = patterns.select("n", *names, (F.col("n") * good).alias("g"))
        sums = [F.sum("n").alias("n"), F.sum("g").alias("g")]
        for name in names:
            for v in VOTES:
                hit = F.col(name) == v
                sums += [F.sum(F.when(hit, F.col("n"))).alias(f"n_{name}_{v}"),
                         F.sum(F.when(hit, F.col("g"))).alias(f"g_{name}_{v}")]
        row = {k: float(v or 0) for k, v in weighed.agg(*sums).first().asDict().items()}
        model = {"good": (row["g"] + 1) / (row["n"] + 2)}
        for name in names:
            for v in VOTES:
                g, n = row[f"g_{name}_{v}"], row[f"n_{name}_{v}"]
                model[name, v, 1] = (g + 1) / (row["g"] + 3)
                model[name, v, 0] = (n - g + 1) / (row["n"] - row["g"] + 3)
        good = F.lit(1.0) / (1 + F.exp(-_logit(names, model)))
    return model


def judge(documents: DataFrame, *, at_least: float = 0.5, rounds: int = 15) -> DataFrame:
    """Counts, votes, ``quality`` (posterior probability of good text), ``base_failed`` and ``kept`` for every row.

    The rules are weighed over the documents that pass the base rule, which decides the others by itself. Null and
    empty texts fail it. Rows without doc_id are judged like all others; repeated rows give
    repeated results; an empty table gives an empty result; columns other than doc_id and text are not read.
    """
    found = rules()
    names = list(found)
    voted = cut_lineage(counts(documents.select("doc_id", "text")).select(
        "*", base_failed().alias("base_failed"), *[v.alias(k) for k, v in found.items()]
    ))
    model = estimate(voted.where("not base_failed"), names, rounds)
    quality = F.lit(1.0) / (1 + F.exp(-_logit(names, model)))
    return voted.withColumn("quality", quality).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= at_least)
    )
