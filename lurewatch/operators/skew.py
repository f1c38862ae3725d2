"""Joins whose keys are skewed: a key's rows are dealt over as many tasks as its measured count asks for.

Adaptive execution can't split a join with a roll-up made in the same stage.
Here the counts of the large side's keys are taken first (combined map-side; a
key column only).  A key with more rows than a task's fair share is heavy, so
there are never more heavy keys than tasks, and their table may be broadcast.
Rows of a heavy key join one of its shares by hash of another column; only the roll-up
rows of heavy keys are repeated, once for each share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Page bodies for one task: a few megabytes, some seconds of patterns.
PAGES_PER_TASK = 2_000


def spread(rows: DataFrame, rows_per_task: int = PAGES_PER_TASK) -> DataFrame:
    """``rows`` of a table, dealt evenly over as many tasks as their count asks for.

    A scan splits files at row groups alone, so a table written by few tasks is
    read by few: the time of the longest then grows with the file.  For rows
    whose processing costs far more than the one shuffle that deals them.
    """
    tasks = -(-rows.count() // rows_per_task)
    return rows.repartition(tasks) if tasks > 1 else rows


def tasks_of(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """(key, _shares) of the keys that hold more than one ``tasks``-th of all rows with a key: fewer rows than ``tasks``.

    ``_shares`` is the number of fair shares that the key's rows fill.
    """
    named = rows.where(F.col(key).isNotNull()).select(key)
    counts = named.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = named.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("_n") * F.lit(tasks) > total).select(key, F.ceil(F.col("_n") * F.lit(tasks) / total).cast("int").alias("_shares"))


def join_by_count(left: DataFrame, rolled: DataFrame, key: str, by: str, counted: DataFrame | None = None, how: str = "left", tasks: int | None = None) -> DataFrame:
    """``left`` joined with ``rolled`` (one row per ``key``); rows of a heavy key are told apart by hash of ``by``.

    ``counted`` is a cheaper table with the same keys as ``left`` to take the counts from.  A null key joins nothing.
    """
    few = F.broadcast(heavy_keys(counted if counted is not None else left, key, tasks or tasks_of(left)))  # fewer rows than tasks
    dealt = left.join(few, key, "left").withColumn("_share", F.when(F.col("_shares") > 1, F.pmod(F.xxhash64(by), F.col("_shares"))).otherwise(F.lit(0)).cast("int")).drop("_shares")
    repeated = rolled.join(few, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return dealt.join(repeated, [key, "_share"], how).drop("_share")
