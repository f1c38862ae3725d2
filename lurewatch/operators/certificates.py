"""Certificate history kept up to date from the certificate stream.

Each message adds, for every registrable domain that it names, one certificate
and its date.  A batch is reduced to a partial aggregate (count, earliest) per
registrable, and merged into a table changed by delta: only the buckets of
registrables in the batch are read and written, whatever the history holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lurewatch.operators.suffix import with_registrable
from lurewatch.rules import RuleSet
from lurewatch.sources.feeds import ct_hosts
from lurewatch.sources.store import Delta, materialise, passing

SCHEMA = "registrable string, cert_count long, earliest_date string"


def partial_history(messages: DataFrame, rules: RuleSet, value_col: str = "value") -> DataFrame:
    """(registrable, cert_count, earliest_date) of certificate messages; a message counts once for each registrable it names."""
    dated = messages.select(F.col(value_col).alias("value"), F.monotonically_increasing_id().alias("_m"))
    leaf = F.try_parse_json("value")
    date = F.coalesce(F.try_variant_get(leaf, "$.data.leaf_cert.not_before", "string"), F.try_variant_get(leaf, "$.data.seen", "string"))
    hosts = ct_hosts(dated.withColumn("date", F.when(date != "", date)))
    named = with_registrable(hosts.select("_m", "date", "host"), rules).where(F.col("registrable") != "")
    once = named.groupBy("registrable", "_m").agg(F.min("date").alias("date"))
    return once.groupBy("registrable").agg(F.count(F.lit(1)).alias("cert_count"), F.min("date").alias("earliest_date"))


def history_table(spark: SparkSession, path: str, buckets: int = 64) -> Delta:
    return Delta(spark, path, SCHEMA, "registrable", buckets)


def merge_history(table: Delta, partial: DataFrame, batch_id: int) -> None:
    """Adds a batch's partial aggregate to the table; a repeated batch gives the same."""
    before = table.read(batch_id).join(partial.select("registrable"), "registrable", "left_semi")
    merged = before.unionByName(partial).groupBy("registrable").agg(F.sum("cert_count").alias("cert_count"), F.min("earliest_date").alias("earliest_date"))
    table.change(batch_id, partial.select("registrable").limit(0), merged)


def start_history(spark: SparkSession, landing: str, path: str, checkpoint: str, rules: RuleSet, trigger: dict | None = None, files: int | None = None) -> StreamingQuery:
    """Follows the landing files of the certificate stream; ``files`` bounds those of one batch."""
    table = history_table(spark, path)
    reader = spark.readStream.format("text")
    messages = (reader.option("maxFilesPerTrigger", files) if files else reader).load(landing)

    def process(batch: DataFrame, batch_id: int) -> None:
        with passing(spark, "certificates"):
            merge_history(table, materialise(partial_history(batch, rules), "history"), batch_id)

    return messages.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def history_structs(table: Delta) -> DataFrame:
    """(registrable, ct) as the context build expects it."""
    return table.read().select("registrable", F.struct(F.col("cert_count").cast("int").alias("cert_count"), "earliest_date", F.lit(None).cast("string").alias("error")).alias("ct"))
