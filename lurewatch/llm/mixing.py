"""Mixing sources to target weights by Efraimidis-Spirakis sampling.  DataFrame operations only.

Each source gets a word budget.  Complete epochs come first; the rest of the
budget is a weighted sample without replacement: each document draws a uniform
number ``u`` and gets the key ``-ln(u) / quality``, keys are sorted within the
source and the running sum of sizes is cut at the budget.

The order within a source is dealt into buckets of the key, so the sorted
running sum of a source that holds most rows is many small windows plus one
sum over bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.scratch import Scratch

#: A word: a run of characters other than space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a bucket of the order within a source aims at.
BUCKET_ROWS = 2000
#: Least quality weight; it keeps every document's chance above zero.
LEAST_WEIGHT = 0.05


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_quality(text: Column, size: Column) -> Column:
    """1 minus the markup symbols per word, at least ``LEAST_WEIGHT``; 1 for a text without words."""
    symbols = F.coalesce(F.length(F.regexp_replace(text, r"[^#*$%&|<>!]", "")), F.lit(0))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - symbols.cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the id's md5: the same on every run and every cluster."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def targets(sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all words; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight, until none is above.
    With sources sorted by size per weight that is a water level: the sources
    up to some place are full and the others hold the level times their weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_weight"))
    first = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_level")))).over(whole)
    water = F.coalesce(first["_level"], F.lit(float("inf")))
    return leveled.withColumn("target", F.least(F.col("_cap"), water * F.col("_weight"))).select("source", "source_size", "target")


def mix(docs: DataFrame, quality: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
        most: float = 2.0, seed: str = "mix-1", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken and ``copies`` (plus ``extra`` columns).

    ``copies`` is how often the document enters the mix and ``taken`` that
    times its size: the complete epochs, and one more if it is in the weighted
    sample that fills the rest of its source's target.  The document on the
    edge of the budget is in if more than half of it fits.  Null text: size 0.
    Null source: a source of its own, last in order.  A null weight counts as
    ``LEAST_WEIGHT``.  Repeated rows are documents each; equal ids draw equal
    numbers.  No documents: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = n_words(F.col("text"))
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(quality if quality is not None else symbol_quality(F.col("text"), F.col("size")), F.lit(LEAST_WEIGHT)))
    # the texts are read once; only a few numbers of each document move on
    rows = scratch.write(docs.withColumn("size", size).select(
        "doc_id", "source", "size", weight.alias("_weight"),
        (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("_key"), *extra))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"), F.avg("_weight").alias("_mean"))
    goal = targets(per_source.select("source", "source_size"), list(weights), share, most)
    plan = scratch.write(goal.join(per_source.select("source", "_rows", "_mean"), goal["source"].eqNullSafe(per_source["source"])).select(
        goal["source"], "source_size", "target", "_rows", "_mean"), 1)
    # keys follow an exponential law of about the mean weight, so this deals a source's order evenly; equal keys stay together
    n = F.ceil(F.col("_rows") / F.lit(BUCKET_ROWS))
    bucket = F.least(n - 1, F.floor((F.lit(1.0) - F.exp(-F.col("_key") * F.col("_mean"))) * n)).alias("_bucket")
    dealt = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.*", "p.source_size", "p.target", bucket)
    totals = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "_bucket", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d").join(
        offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d._bucket") == F.col("o._bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    sampled = (F.col("_before") + F.col("_inside")).cast("double") + F.col("size") / F.lit(2.0) < rest
    copies = (epochs + F.when(sampled, 1).otherwise(0)).cast("long")
    return run.select("d.doc_id", "d.size", "d.source_size", "d.target", (copies * F.col("size")).cast("long").alias("taken"),
                      copies.alias("copies"), *[f"d.{c}" for c in extra])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix of all ``documents``: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(length(regexp_replace(text, '[^#*$%&|<>!]', '', 'g')), 0) AS symbols
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((CAST(CAST('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
         / greatest(0.05, 1.0::DOUBLE - CAST(symbols AS DOUBLE) / greatest(size, 1)::DOUBLE) AS key
  FROM s
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM src
), lv AS (
  SELECT a.source, a.source_size, a.cap, a.weight,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
          - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.weight < a.cap / a.weight), 0))
         / (SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight >= a.cap / a.weight) AS lvl
  FROM w a
), t AS (
  SELECT source, source_size,
         least(cap, weight * coalesce((SELECT arg_min(lvl, cap / weight) FROM lv WHERE cap > lvl * weight), 'inf'::DOUBLE)) AS target
  FROM lv
), r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
