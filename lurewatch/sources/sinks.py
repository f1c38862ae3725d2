"""Verdict sinks.

Brand-attributed verdicts go to ``<root>/brands/brand=<b>/verdict=<v>/``,
irrelevant hosts to ``<root>/irrelevant/`` (no brand directory), rows with a
null verdict (trusted, dropped) are never written.  ``fmt='text'`` writes one
stripped host per line (the reference's file layout, partitioned); the default
parquet form keeps every column.  Writes append, and a ``batch_id`` column
(streaming) makes a replayed micro-batch detectable downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.sources.store import materialise


def write_verdicts(df: DataFrame, root: str, fmt: str = "parquet", mode: str = "append") -> None:
    # written once: each part would otherwise run the whole triage for itself
    out = materialise(df.where(F.col("verdict").isNotNull()).withColumn("host", F.trim(F.col("host"))), "verdicts")
    brands = out.where(F.col("brand").isNotNull())
    irrelevant = out.where(F.col("brand").isNull())
    if fmt == "text":
        brands.select("host", "brand", "verdict").write.mode(mode).partitionBy("brand", "verdict").text(
            f"{root}/brands")
        irrelevant.select("host").write.mode(mode).text(f"{root}/irrelevant")
    else:
        brands.write.mode(mode).partitionBy("brand", "verdict").parquet(f"{root}/brands")
        irrelevant.drop("brand").write.mode(mode).parquet(f"{root}/irrelevant")


def write_batches(df: DataFrame, root: str) -> None:
    """Verdicts with a ``batch_id``, in partitions brand / verdict / batch: a batch written again replaces its own files only."""
    rows = df.withColumn("host", F.trim("host"))
    for part, keys, name in ((rows.where(F.col("brand").isNotNull()), ["brand", "verdict", "batch_id"], "brands"),
                             (rows.where(F.col("brand").isNull()).drop("brand"), ["batch_id"], "irrelevant")):
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root}/{name}")


def read_verdicts(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Read a sink back as ``host, brand, verdict`` (irrelevant rows get a null brand)."""
    if fmt == "text":
        b = (spark.read.option("basePath", f"{root}/brands").text(f"{root}/brands")
                  .select(F.col("value").alias("host"), "brand", "verdict"))
        i = spark.read.text(f"{root}/irrelevant").select(
            F.col("value").alias("host"), F.lit(None).cast("string").alias("brand"),
            F.lit("irrelevant").alias("verdict"))
    else:
        # schemas are given: either part may hold no file
        b = spark.read.schema("host string, brand string, verdict string").parquet(f"{root}/brands").select("host", "brand", "verdict")
        i = spark.read.schema("host string, verdict string").parquet(f"{root}/irrelevant").select(
            "host", F.lit(None).cast("string").alias("brand"), "verdict")
    return b.unionByName(i)
