"""Poll cadence per source (A15) and the choice of a mirror per cycle.

Sources of one interval are one streaming query, so each group advances on its
own.  A micro-batch is a poll cycle: when it closes, feeds with mirrors give the
lines of their best one.  Cycles are written to a shared landing log,
``<log>/every=<seconds>/cycle=<batch>``; a repeated cycle replaces its own files.
``stream_log`` reads the log as one stream, with the triage's dedup behind it, so a
host that several groups name is still triaged once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lurewatch.sources.feeds import DEFAULT_SOURCES, Source, best_mirror

LOG_SCHEMA = "source string, host string, every int, cycle long"


def groups(enabled: Iterable[str], sources: Iterable[Source] = DEFAULT_SOURCES) -> dict[int, list[Source]]:
    """Enabled sources that have a stream, by poll interval in seconds (0: a push source, without one)."""
    names, out = set(enabled), {}
    for s in sources:
        if s.name in names and (s.stream or s.mirrors):
            out.setdefault(s.interval_s, []).append(s)
    return dict(sorted(out.items()))


def start_group(spark: SparkSession, every: int, sources: list[Source], root: str, log: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Polls the sources of one interval; ``once`` takes what has landed and ends."""
    plain = [F.lit(None).cast("int").alias("prio"), F.lit(True).alias("filled")]
    streams = [s.mirrors(spark, f"{root}/{s.name}") if s.mirrors else s.stream(spark, f"{root}/{s.name}").select("source", "host", *plain) for s in sources]
    rows = reduce(DataFrame.unionByName, streams)

    def land(cycle: DataFrame, batch_id: int) -> None:
        cycle = cycle.persist()  # read for the choice and for the lines
        try:
            chosen = best_mirror(cycle).dropDuplicates(["source", "host"]).withColumn("every", F.lit(every)).withColumn("cycle", F.lit(batch_id))
            chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("every", "cycle").parquet(log)
        finally:
            cycle.unpersist()

    trigger = {"availableNow": True} if once or every == 0 else {"processingTime": f"{every} seconds"}
    return rows.writeStream.foreachBatch(land).option("checkpointLocation", f"{checkpoint}/every={every}").trigger(**trigger).start()


def start_groups(spark: SparkSession, root: str, log: str, checkpoint: str, enabled: Iterable[str], sources: Iterable[Source] = DEFAULT_SOURCES, once: bool = False) -> dict[int, StreamingQuery]:
    """One query for each interval."""
    return {every: start_group(spark, every, members, root, log, checkpoint, once) for every, members in groups(enabled, sources).items()}


def stream_log(spark: SparkSession, log: str) -> DataFrame:
    """(source, host) of all groups' cycles as one stream."""
    return spark.readStream.schema(LOG_SCHEMA).parquet(log).select("source", "host")
