"""Hosts seen by earlier loads (C11, W3 for batch loads): a bucketed table with a Bloom filter ahead of its anti-join.

The table is Spark's own: bucketed by host, partitioned by load, one file per
bucket and load.  An anti-join reads it bucket by bucket, so only the new hosts
are shuffled.  Before that, a Bloom filter of all earlier loads tells which new
hosts can't have been seen; they skip the join.  The filter is a set of
bitmaps of fixed size (``bits``), so it may be broadcast whatever the table holds.

A load sees the loads before its own only, and replaces its own partition and
filter: repeated, it gives the same hosts and leaves the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.sources.store import names

#: Bits of one of Spark's bitmaps.
WORD = 8 * 4096


class SeenHosts:
    def __init__(self, spark: SparkSession, table: str, root: str, buckets: int = 64, bits: int = 1 << 22, hashes: int = 4):
        """``bits`` / 8 bytes are broadcast; about ten bits for each host expected keep false alarms near one in a hundred.

        ``buckets`` should be no fewer than ``spark.sql.shuffle.partitions``, or Spark deals the table anew for a join.
        """
        self.spark, self.table, self.root, self.buckets, self.hashes = spark, table, root.rstrip("/"), buckets, hashes
        self.bits = -(-bits // WORD) * WORD
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (host STRING, load BIGINT) USING parquet PARTITIONED BY (load) "
                  f"CLUSTERED BY (host) SORTED BY (host) INTO {buckets} BUCKETS LOCATION '{self.root}/hosts'")
        if names(spark, f"{self.root}/hosts"):  # partitions that another session wrote
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    def _position(self, i: int):
        return F.pmod(F.xxhash64(F.lit(i), "host"), F.lit(self.bits))

    def _filter(self, before: int) -> DataFrame | None:
        """(word, bits) of the loads before ``before``, bits a bitmap."""
        loads = [int(n.partition("=")[2]) for n in names(self.spark, f"{self.root}/filter") if n.startswith("load=")]
        loads = [n for n in loads if n < before]
        return self.spark.read.schema("word long, bits binary").parquet(f"{self.root}/filter/load={max(loads)}") if loads else None

    def split(self, hosts: DataFrame, load: int) -> tuple[DataFrame, DataFrame]:
        """Distinct hosts that the filter rules out, and those that may have been seen."""
        rows = hosts.dropDuplicates(["host"])
        bitmaps = self._filter(load)
        if bitmaps is None:
            return rows, rows.limit(0)
        may = F.lit(True)
        marked = rows
        for i in range(self.hashes):
            at = self._position(i)
            word = F.broadcast(bitmaps.select(F.col("word").alias(f"_w{i}"), F.col("bits").alias(f"_b{i}")))  # ``bits`` / 8 bytes
            marked = marked.withColumn(f"_p{i}", at % WORD).withColumn(f"_k{i}", F.floor(at / WORD)).join(word, F.col(f"_k{i}") == F.col(f"_w{i}"), "left")
            byte = F.conv(F.hex(F.substring(F.col(f"_b{i}"), (F.col(f"_p{i}") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            bit = F.floor(byte / F.pow(F.lit(2.0), F.col(f"_p{i}") % 8)) % 2
            may = may & F.coalesce(bit == 1, F.lit(False))
        marked = marked.withColumn("_may", may).select(*rows.columns, "_may")
        return marked.where(~F.col("_may")).drop("_may"), marked.where("_may").drop("_may")

    def unseen(self, hosts: DataFrame, load: int) -> DataFrame:
        """Rows of ``hosts`` (one for each host, any of equal ones) whose host no earlier load has."""
        new, perhaps = self.split(hosts, load)
        earlier = self.spark.table(self.table).where(F.col("load") < load).select("host")
        # dealt like the table's buckets, so that the table stays where it is
        dealt = perhaps.repartition(self.buckets, "host")
        return new.unionByName(dealt.join(earlier.hint("merge"), "host", "left_anti"))

    def add(self, hosts: DataFrame, load: int) -> None:
        """Makes ``hosts`` the hosts of this load."""
        rows = hosts.select("host").distinct()
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        rows.select("host", F.lit(load).cast("long").alias("load")).write.insertInto(self.table, overwrite=True)
        added = self.spark.table(self.table).where(F.col("load") == load)
        places = added.select(F.explode(F.array(*[self._position(i) for i in range(self.hashes)])).alias("p"))
        bitmaps = places.groupBy(F.floor(F.col("p") / WORD).alias("word")).agg(F.bitmap_construct_agg(F.col("p") % WORD).alias("bits"))
        before = self._filter(load)
        if before is not None:
            bitmaps = bitmaps.unionByName(before).groupBy("word").agg(F.bitmap_or_agg("bits").alias("bits"))
        bitmaps.write.mode("overwrite").parquet(f"{self.root}/filter/load={load}")
