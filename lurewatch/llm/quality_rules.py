"""Quality rules combined by weak supervision.  DataFrame operations only.

Every rule votes good (1), bad (-1) or abstains (0) on a document.  How often a
rule gives each vote on good and on bad documents is not set by hand: an
expectation-maximisation over the counts of vote patterns estimates it, and a
document is kept by the posterior probability that it is good.  A single
violation thus weighs as much as the corpus says it should, instead of every
rule having to pass.

The texts are read once.  The estimation works on one row for each pattern of
votes (at most 3 to the power of the number of rules), whatever the corpus.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Frequent function words of the corpus's languages (fixed values).
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "de", "la", "le", "les", "et", "des", "que", "el", "en",
                  "los", "un", "une", "der", "die", "und", "das", "von", "den", "mit", "ist", "zu"]
#: Least words of a document, and the most percent of its words that repeated 3-word windows may cover.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Steps of the estimation, the pseudo-count of each vote, and the posterior from which a document is kept.
STEPS, SMOOTH, KEEP_FROM = 20, 1.0, 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, characters: str) -> Column:
    """Characters of a class in the text."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def with_measures(docs: DataFrame) -> DataFrame:
    """Adds the base measures and those of the rules.  A null text measures as an empty one.

    Repeated windows: each 3-word window becomes a number, its hash above and
    its place below, the numbers are sorted, and equal neighbours (compared
    word by word) are repeats.  All of it is linear or a sort within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    filled = F.filter(F.split(F.col("_lines_of"), "\n"), lambda x: x.rlike(NOT_SPACE))
    rows = docs.withColumn("_lines_of", text).withColumns({
        "_words": F.filter(F.split(F.col("_lines_of"), SPACE), lambda w: w != ""), "_lines": filled})
    n = F.size("_words")
    bits = F.length(F.bin(n.cast("long"))).cast("int")
    rows = rows.withColumn("_bits", bits)
    words = F.col("_words")
    window = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.coalesce(F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")), F.lit(0).cast("long")))
    rows = rows.withColumn("_sorted", F.sort_array(window))
    windows = F.col("_sorted")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")

    def same(x: Column, y: Column) -> Column:
        equal = F.call_function("shiftright", x, F.col("_bits")) == F.call_function("shiftright", y, F.col("_bits"))
        return F.coalesce(equal & reduce(lambda a, b: a & b, [F.get(words, place(x) + k) == F.get(words, place(y) + k) for k in range(3)]), F.lit(False))

    repeats = F.filter(windows, lambda x, i: same(x, F.get(windows, i + 1)) | F.when(i > 0, same(x, F.get(windows, i - 1))).otherwise(F.lit(False)))
    rows = rows.withColumn("_places", F.sort_array(F.transform(repeats, lambda x: F.coalesce(place(x), F.lit(0)))))
    places = F.col("_places")
    covered = F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    body = F.col("_lines_of")
    return rows.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
        "n_symbols": _count(body, r"#*$%&|<>"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"), "_n_lines": F.size("_lines"), "_upper": _count(body, r"\p{Lu}"), "_letters": _count(body, r"\p{L}"),
        "_marks": _count(body, "!?"), "_function": F.size(F.filter(words, lambda w: F.lower(w).isin(FUNCTION_WORDS))),
        "_ended": F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?\"'»”)]\s*$"))),
    }).drop("_lines_of", "_words", "_lines", "_bits", "_sorted", "_places")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: name to vote, over the measures.  Each abstains between its two thresholds."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines, letters = F.greatest(F.col("_n_lines"), F.lit(1)), F.greatest(F.col("_letters"), F.lit(1))
    symbols, upper, marks = F.col("n_symbols") / n, F.col("_upper") / letters, F.col("_marks") / n
    repeated, copied, length = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines, F.col("word_chars") / n
    function, ended = F.col("_function") / n, F.col("_ended") / lines
    return {
        "symbols": _vote(symbols > 0.2, symbols < 0.02),
        "capitals": _vote(upper > 0.5, upper < 0.25),
        "marks": _vote(marks > 0.3, marks < 0.1),
        "repeats": _vote(repeated > 0.3, repeated < 0.1),
        "same_lines": _vote(copied > 0.3, copied < 0.1),
        "word_length": _vote((length < 2) | (length > 15), (length > 3) & (length < 12)),
        "function_words": _vote(function < 0.02, function > 0.1),
        "line_ends": _vote(ended < 0.2, ended > 0.8),
    }


def posterior(model: list[float]) -> Column:
    """Probability that a document is good: logistic of the prior's log odds (last in ``model``) and one addend for each vote.

    The model is a JSON literal, so every step of the estimation runs the same compiled code.
    """
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    odds = F.aggregate(F.col("_votes"), F.element_at(table, -1), lambda total, at: total + F.get(table, at))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(patterns: DataFrame, n_rules: int, steps: int = STEPS) -> list[float]:
    """Log likelihood ratios of the votes (three for each rule) and the prior's log odds, by expectation-maximisation over (_votes, _n).

    The start believes a document with any bad vote to be bad.  Every rate has
    a pseudo-count, so that no vote is impossible.  Without documents the rates stay even.
    """
    bad = F.exists("_votes", lambda at: at % 3 == 0)
    good, model = F.when(bad, 0.1).otherwise(0.9), []
    for _ in range(steps):
        weighed = patterns.select("_n", good.alias("_good"), F.explode(F.concat("_votes", F.array(F.lit(3 * n_rules)))).alias("_at"))
        rows = weighed.groupBy("_at").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_good")).alias("good")).collect()  # a row for each vote
        seen = {r["_at"]: (float(r["n"]), r["good"]) for r in rows}
        total, on_good = seen.get(3 * n_rules, (0.0, 0.0))
        model = []
        for at in range(3 * n_rules):
            n, g = seen.get(at, (0.0, 0.0))
            model.append(math.log((g + SMOOTH) / (on_good + 3 * SMOOTH)) - math.log((n - g + SMOOTH) / (total - on_good + 3 * SMOOTH)))
        model.append(math.log((on_good + SMOOTH) / (total - on_good + SMOOTH)))
        model = [round(x, 9) for x in model]  # the order in which partial sums meet must not show
        good = posterior(model)
    return model


def score(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, the base measures, base_failed, quality (posterior) and kept.

    Null and empty texts have no words and fail the base rules.  Repeated rows
    are judged each, and alike.  Columns not in ``keep`` are dropped; a kept
    column that has the name of a result gives way to it.  An empty table gives
    no rows.
    """
    rules = votes()
    kept = [c for c in keep if c not in (*BASE, "base_failed", "quality", "kept")]
    scratch = Scratch(docs.sparkSession, "rules")
    inner = docs.select(*[F.col(c).alias(f"_k_{c}") for c in kept], F.col("text"))
    measured = with_measures(inner)
    judged = scratch.write(measured.select(*[f"_k_{c}" for c in kept], *BASE, F.array(*[v + 1 + 3 * i for i, v in enumerate(rules.values())]).alias("_votes")))
    patterns = scratch.write(judged.groupBy("_votes").agg(F.count(F.lit(1)).alias("_n")), 1)
    model = estimate(patterns, len(rules))
    scratch.drop(patterns)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = judged.withColumns({"base_failed": failed, "quality": posterior(model)})
    return out.select(*[F.col(f"_k_{c}").alias(c) for c in kept], *BASE, "base_failed", "quality",
                      (~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)).alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures, posterior and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, ["doc_id"])
