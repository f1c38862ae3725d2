"""Small files and versioned tables in a shared folder, through Hadoop's file system (any store that Spark reads)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.session import checkpoint_dir


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    found, files = _path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(found)) if files.exists(found) else []


def remove(spark: SparkSession, path: str) -> None:
    found, files = _path(spark, path)
    files.delete(found, True)


def put_json(spark: SparkSession, path: str, value) -> None:
    """Writes a small file whole or not at all."""
    part, files = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(part, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    found, _ = _path(spark, path)
    files.delete(found, False)
    files.rename(part, found)


def get_json(spark: SparkSession, path: str):
    found, files = _path(spark, path)
    source = files.open(found)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def passing(spark: SparkSession, tag: str) -> Iterator[None]:
    """Tables that are materialised inside are removed at the end: for a micro-batch, whose results lie in its sink by then."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    token = _FOLDER.set(path)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        remove(spark, path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    path = f"{(_FOLDER.get() or checkpoint_dir(spark)).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Delta:
    """A keyed set of rows changed batch by batch: only the buckets that a batch touches are written.

    ``path/rows/version=<batch>/bucket=<k>`` holds the rows of a bucket as that
    batch left it, and ``path/manifests/<batch>.json`` the version of every
    bucket: one small file, whose size is bounded by ``buckets``.  A batch reads the manifest before its
    own, so a replayed batch sees what the first attempt saw and overwrites its
    own files.  Versions that neither of the last two manifests names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self, before: int | None) -> list[int]:
        ids = sorted(int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/manifests") if n.endswith(".json"))
        return [i for i in ids if before is None or i < before]

    def _manifest(self, batch: int | None) -> dict[int, int]:
        return {int(k): v for k, v in get_json(self.spark, f"{self.path}/manifests/{batch}.json").items()} if batch is not None else {}

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """Rows as batch ``before`` finds them (the latest without one), of all buckets or ``only`` some."""
        at = self._manifests(before)
        held = self._manifest(at[-1] if at else None)
        paths = [f"{self.path}/rows/version={v}/bucket={k}" for k, v in held.items() if only is None or k in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, batch: int, gone: DataFrame, added: DataFrame) -> None:
        """Removes the keys of ``gone`` and adds the rows of ``added`` (whose keys replace those there)."""
        touched = gone.select(self.key).unionByName(added.select(self.key)).select(self.bucket().alias("b")).distinct()
        only = {r.b for r in touched.collect()}  # at most ``buckets`` numbers
        at = self._manifests(batch)
        held = self._manifest(at[-1] if at else None)
        leave = gone.select(self.key).unionByName(added.select(self.key)).distinct()
        rows = self.read(batch, only).join(leave, self.key, "left_anti").unionByName(added)
        rows.withColumn("bucket", self.bucket()).repartition(self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={batch}")
        made = {int(n.partition("=")[2]) for n in names(self.spark, f"{self.path}/rows/version={batch}") if n.startswith("bucket=")}
        put_json(self.spark, f"{self.path}/manifests/{batch}.json", {k: v for k, v in held.items() if k not in only} | {k: batch for k in made})
        if len(at) > 1:
            keep = {*held.items(), *self._manifest(batch).items()}
            for k, v in self._manifest(at[-2]).items():
                if (k, v) not in keep:
                    remove(self.spark, f"{self.path}/rows/version={v}/bucket={k}")
            for old in at[:-1]:
                remove(self.spark, f"{self.path}/manifests/{old}.json")
