"""Scoring and verdicts.

One projection evaluates every rule into its own struct column; the next
derives the ordered first-definitive rule (G2), the weighted tally as a plain
sum of ``when`` terms (G3, stays in whole-stage codegen), the normalised score
(G4) and the verdict (G5).  Gates run before: a trusted host is dropped
(``verdict`` null), an auto-scam host is ``scam`` without rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators.heuristics import DEFAULT_REGISTRY, Rule, RuleContext, shared_columns
from lurewatch.operators.match import gate
from lurewatch.rules import VERDICTS, RuleSet


def _rcol(i: int) -> str:
    return f"__rule_{i:02d}"


def evaluate_rules(context: DataFrame, rules: RuleSet, as_of: Column,
                   registry: Sequence[Rule] = DEFAULT_REGISTRY, with_evidence: bool = True) -> DataFrame:
    """Append one result struct per rule (``__rule_01`` ...) plus shared helper columns.

    ``with_evidence=False`` skips the evidence strings (verdict-only callers):
    a much smaller generated projection.
    """
    ctx = RuleContext(rules, as_of, with_evidence)
    staged = context.select("*", *shared_columns(rules, as_of, [r.name for r in registry]))
    return staged.select("*", *[r.outcome(ctx).alias(_rcol(i)) for i, r in enumerate(registry, 1)])


def rule_results(registry: Sequence[Rule] = DEFAULT_REGISTRY) -> Column:
    """G1: ordered ``array<struct<name, weight, scam, benign, suspicious, evidence>>``."""
    return F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.weight).alias("weight"),
                              F.col(_rcol(i))["scam"].alias("scam"), F.col(_rcol(i))["benign"].alias("benign"),
                              F.col(_rcol(i))["suspicious"].alias("suspicious"),
                              F.col(_rcol(i))["evidence"].alias("evidence"))
                     for i, r in enumerate(registry, 1)])


def classify(context: DataFrame, rules: RuleSet, as_of: Column,
             registry: Sequence[Rule] = DEFAULT_REGISTRY, keep_results: bool = False) -> DataFrame:
    """G2-G5 on a context frame (one row per host).

    Adds ``decided_by`` (first definitive rule), ``tally``, ``score``,
    ``verdict`` and optionally ``results`` (the ordered result array).
    Rows whose host is trusted get a null verdict (dropped by the sinks).
    """
    ev = evaluate_rules(context, rules, as_of, registry, with_evidence=keep_results)
    total = sum(r.weight for r in registry)
    first_def = F.coalesce(*[F.when(F.col(_rcol(i))["scam"] | F.col(_rcol(i))["benign"],
                                    F.struct(F.lit(r.name).alias("name"),
                                             F.col(_rcol(i))["scam"].alias("scam")))
                             for i, r in enumerate(registry, 1)])
    tally = sum((F.when(F.col(_rcol(i))["suspicious"], F.lit(r.weight)).otherwise(F.lit(0))
                 for i, r in enumerate(registry, 1)), F.lit(0))
    score = (tally / F.lit(total)) if total > 0 else F.lit(0.0)
    g = gate(F.col("host"), rules)
    verdict = (F.when(g == "dropped", F.lit(None).cast("string"))
                .when(g == "scam", F.lit("scam"))
                .when(F.col("_first").isNotNull(),
                      F.when(F.col("_first.scam"), F.lit("scam")).otherwise(F.lit("benign")))
                .when(F.col("score") >= F.lit(rules.thresholds.scam), F.lit("scam"))
                .otherwise(F.lit("inconclusive")))
    # one projection per step (chained withColumn would re-analyse the wide plan each time)
    staged = ev.select("*", first_def.alias("_first"), tally.cast("int").alias("tally"))
    staged = staged.select("*", score.cast("double").alias("score"))
    out = staged.select("*", F.when(g.isNull(), F.col("_first.name")).alias("decided_by"), verdict.alias("verdict"))
    if keep_results:
        out = out.withColumn("results", rule_results(registry))
    failing = [F.col(_rcol(i))["error"] for i, r in enumerate(registry, 1) if r.can_fail]
    if failing:
        # a host on which a rule failed has no verdict
        out = out.withColumn("rule_error", F.when(g.isNull(), F.coalesce(*failing, F.lit(None).cast("string"))))
        out = out.withColumn("verdict", F.when(F.col("rule_error").isNotNull(), F.lit("failed")).otherwise(F.col("verdict")))
    drop = [_rcol(i) for i in range(1, len(registry) + 1)] + ["_first", "_lookalike", "_reg_age", "_diff_ratio"]
    return out.drop(*drop)


def explain_long(context: DataFrame, rules: RuleSet, as_of: Column,
                 registry: Sequence[Rule] = DEFAULT_REGISTRY) -> DataFrame:
    """One row per host x rule that fired (scam, benign or suspicious), with evidence."""
    ev = evaluate_rules(context, rules, as_of, registry)
    rows = ev.select("host", F.inline(F.filter(rule_results(registry),
                                               lambda r: r["scam"] | r["benign"] | r["suspicious"])))
    return rows.select("host", "name", "weight",
                       F.when(F.col("scam"), "scam").when(F.col("benign"), "benign")
                        .otherwise("suspicious").alias("outcome"), "evidence")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Count per verdict, zero-filled over the four verdict values (nulls are dropped rows)."""
    spark = verdicts.sparkSession
    allv = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    counts = verdicts.where(F.col("verdict").isNotNull()).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per verdict value (a closed domain of five): a proven-small broadcast
    return allv.join(F.broadcast(counts), "verdict", "left").select(
        "verdict", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
