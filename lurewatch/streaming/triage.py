"""Structured Streaming triage.

``readStream`` landing files of every enabled source -> union (W2) ->
normalise -> global exact dedup on ``host`` in checkpointed state (W3,
survives restarts; use the RocksDB state store provider for size) ->
``foreachBatch`` (W1): brand attribution, gates, a stream-static join to the
latest capture tables (W6), rules, verdict, and an idempotent append of the
batch to the sink keyed by ``batch_id`` (W5: a replayed batch overwrites only
its own ``batch_id`` partition).  Hosts that wait for their capture are a table of
their own next to the sink, changed by each batch (``sources.store.Delta``): a
batch takes up those whose capture has arrived and never reads the sink, so its
work follows its own hosts, the new captures and the waiting hosts, not history.
``latest_verdicts`` reads the sink with one row per host; ``settle`` carries new
batches over to the brand/verdict layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lurewatch.operators.heuristics import DEFAULT_REGISTRY, Rule
from lurewatch.plans.triage import Captures, triage
from lurewatch.rules import RuleSet
from lurewatch.sources.feeds import stream_text_feed
from lurewatch.sources.sinks import write_batches
from lurewatch.sources.store import Delta, get_json, materialise, names, passing, put_json, remove


def stream_hosts(spark: SparkSession, root: str, feeds: Iterable[tuple[str, bool]]) -> DataFrame:
    """Union of text landing directories ``root/<name>`` (name, comment_rule)."""
    dfs = [stream_text_feed(spark, f"{root}/{name}", name, rule) for name, rule in feeds]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


SINK_SCHEMA = ("host string, source string, brand string, verdict string, score double, tally int, decided_by string, "
               "batch_id long")
ERRORS_SCHEMA = "host string, source string, error string, attempts int"
#: Batches that try a host on which a rule fails.
ATTEMPTS = 2
PENDING_SCHEMA = "host string, source string, brand string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_triage(spark: SparkSession, hosts: DataFrame, captures: Callable[[], Captures], rules: RuleSet,
                 as_of: Column, sink: str, checkpoint: str, trigger: dict | None = None,
                 state_store: str | None = ROCKSDB, forget_after: str | None = None,
                 registry: Sequence[Rule] = DEFAULT_REGISTRY, watched: RuleSet | None = None) -> StreamingQuery:
    """Start the streaming triage; ``captures`` is called per batch.

    It may give all captures or only those that have arrived since the batch
    before: hosts seen earlier are found in the pending table either way.

    A host on which a rule of ``registry`` fails goes to the error table with
    the number of its attempts and is tried again in the next batch, ``ATTEMPTS``
    times in all; the batch commits without it (W5).

    Dedup is exact and unbounded by default (every host is triaged once, ever).
    ``forget_after`` (e.g. ``"30 days"``) switches to the bounded form: a host
    is forgotten that long after it was first seen (arrival time) and may be
    triaged again, so the state stays bounded.
    """
    if state_store:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", state_store)
    if forget_after:
        arrived = hosts.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", forget_after)
        deduped = arrived.dropDuplicatesWithinWatermark(["host"]).drop("seen_at")
    else:
        # W3 exact dedup in checkpointed state
        deduped = hosts.dropDuplicates(["host"])
    # per-batch host count, observable in the query progress
    deduped = deduped.observe("triage_input", F.count(F.lit(1)).alias("new_hosts"))

    empty = hosts.sparkSession.createDataFrame([], SINK_SCHEMA)
    empty.write.mode("append").partitionBy("batch_id").parquet(sink)  # later batches read the folder

    def process(batch: DataFrame, batch_id: int) -> None:
        with passing(spark, "batch"):
            settle_batch(batch, batch_id)

    def settle_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by every roll-up of the batch
        waiting, errors = pending_table(spark, sink), error_table(spark, sink)
        try:
            latest = captures()
            raw = batch.select(F.col("host").alias("line"), "source")
            taken = due(spark, sink, latest.http, batch_id) if latest.http is not None else None
            if taken is not None:
                taken = materialise(taken, "due")
                raw = raw.unionByName(taken)
            again = materialise(errors.read(batch_id).where(F.col("attempts") < ATTEMPTS), "again")
            raw = raw.unionByName(again.select(F.col("host").alias("line"), "source"))
            every = triage(raw, latest, rules, as_of, registry=registry, watched=watched).withColumn("batch_id", F.lit(batch_id))
            every = materialise(every.where(F.col("verdict").isNotNull()), "batch")
            failed, out = every.where(F.col("verdict") == "failed"), every.where(F.col("verdict") != "failed")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink)
            still = out.where(F.col("verdict") == "pending").select("host", "source", "brand")
            settled = taken.select(F.col("line").alias("host")) if taken is not None else still.select("host").limit(0)
            waiting.change(batch_id, settled, still)
            tried = failed.join(again.select("host", F.col("attempts").alias("_before")), "host", "left")
            errors.change(batch_id, again.select("host"), tried.select("host", "source", F.col("decided_by").alias("error"), (F.coalesce("_before", F.lit(0)) + 1).alias("attempts")))
        finally:
            batch.unpersist()

    writer = deduped.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def pending_table(spark: SparkSession, sink: str) -> Delta:
    """Hosts that wait for their capture, next to the sink."""
    return Delta(spark, f"{sink.rstrip('/')}-pending", PENDING_SCHEMA, "host")


def error_table(spark: SparkSession, sink: str) -> Delta:
    """Hosts on which a rule failed, next to the sink."""
    return Delta(spark, f"{sink.rstrip('/')}-errors", ERRORS_SCHEMA, "host")


def latest_verdicts(spark: SparkSession, sink: str, after: int | None = None) -> DataFrame:
    """One row per host of a streamed sink: the one of its latest batch (of the batches past ``after`` if given)."""
    rows = spark.read.schema(SINK_SCHEMA).parquet(sink)
    if after is not None:
        rows = rows.where(F.col("batch_id") > after)
    rest = [c for c in rows.columns if c != "host"]
    return rows.groupBy("host").agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_l")).select("host", "_l.*")


def due(spark: SparkSession, sink: str, http: DataFrame, batch_id: int) -> DataFrame:
    """(line, source) of the hosts still pending after the earlier batches that now have a page capture.

    Only earlier batches count, so a replayed batch takes up the same hosts again.
    """
    waiting = pending_table(spark, sink).read(batch_id)
    return waiting.join(http.select("host").distinct(), "host", "left_semi").select(F.col("host").alias("line"), "source")


def settle(spark: SparkSession, sink: str, root: str) -> None:
    """Carries the batches since the last call over to the brand/verdict layout of the batch sink.

    Verdicts that stand are appended, each batch in its own ``batch_id``
    partition, so a repeated call writes the same files again; of the pending ones,
    which later batches replace, only the partitions ``verdict=pending`` are written anew.
    ``settled.json`` names the last batch carried over.
    """
    done = get_json(spark, f"{root}/settled.json") if "settled.json" in names(spark, root) else -1
    new = latest_verdicts(spark, sink, done)
    last = new.agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    write_batches(new.where(F.col("verdict") != "pending"), root)
    for brand in names(spark, f"{root}/brands"):
        remove(spark, f"{root}/brands/{brand}/verdict=pending")
    write_batches(pending_table(spark, sink).read().select("*", F.lit("pending").alias("verdict"), F.lit(last).alias("batch_id")), root)
    put_json(spark, f"{root}/settled.json", last)
