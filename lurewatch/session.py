"""Spark session helpers.

Library code never builds its own session; callers pass one.  ``local_session``
is what tests and ``bench.py`` use.  ``checkpoint_dir`` reads the shared
``spark.checkpoint.dir`` the cluster names and only falls back to a scratch
directory when the setting is absent (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings every entry point relies on.
BASE_CONF: dict[str, str] = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # header maps may carry a key twice once keys are lower-cased
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "lurewatch") -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
               .config("spark.driver.memory", os.environ.get("LUREWATCH_DRIVER_MEM", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Set the SQL settings the operators depend on (runtime-settable only)."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's setting, or a scratch dir when unset."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="lurewatch-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def cluster_conf(capture_bytes: int, feature_ratio: float = 0.05, target_partition_bytes: int = 256 << 20,
                 stateful_stream: bool = False) -> dict[str, str]:
    """Settings for a cluster run, sized from the bytes of page captures to scan.

    * splits of ``target_partition_bytes`` for the scan (the CPU-bound page
      projection runs per split);
    * shuffle partitions sized for what actually shuffles: the page feature
      structs (about ``feature_ratio`` of the bodies) and the roll-ups, at
      ``target_partition_bytes`` each; AQE coalesces small ones and splits skew;
    * RocksDB state for the unbounded streaming dedup.
    ``spark.checkpoint.dir`` is not set here: the cluster names the shared folder.
    """
    shuffle_bytes = max(int(capture_bytes * feature_ratio), target_partition_bytes)
    parts = max(200, -(-shuffle_bytes // target_partition_bytes))
    conf = {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes * 2),
        **BASE_CONF,
    }
    if stateful_stream:
        conf["spark.sql.streaming.stateStore.providerClass"] = (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return conf
