"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only on a local master with no setting (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="lurewatch-llm-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


class Scratch:
    """Tables written by one operator run.

    ``write`` cuts the lineage: a lost executor re-reads files instead of
    recomputing.  ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{folder(spark)}/lurewatch-llm/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
