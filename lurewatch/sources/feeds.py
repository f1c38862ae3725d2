"""Feed sources (A1-A15, U3): landing files -> ``(source, host)`` rows.

Feeds are read from landing directories (one per source) written by whatever
downloads them; the network half of the original pollers is not rebuilt.
Each reader returns ``DataFrame[source, host]`` with the per-cycle distinct
already applied, in batch (``read_*``) or streaming (``stream_*``) form.

Line splitting: Spark's text source breaks on ``\\n``, ``\\r`` and ``\\r\\n``;
``split_lines`` additionally breaks on the other separators Python's
``str.splitlines`` knows, so a body yields the same lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.functions.hosts import normalize_host

EXTRA_LINE_BREAKS = "[\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"

# URLhaus per-country CSV columns (host is the fifth).
CSV_COLUMNS = ("dateadded", "url", "url_status", "threat", "host", "ipaddress", "asnumber", "country")
CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])

# Quotes are doubled inside quotes and nothing else escapes.
CSV_DIALECT = {"quote": '"', "escape": '"'}

CT_MESSAGE_TYPE = "certificate_update"


def split_lines(df: DataFrame, col: str = "value", out: str = "line") -> DataFrame:
    return df.withColumn(out, F.explode(F.split(F.col(col), EXTRA_LINE_BREAKS)))


def select_sources(df: DataFrame, enabled: Iterable[str], col: str = "source") -> DataFrame:
    """Keep enabled sources (partition pruning when ``source`` is a directory partition)."""
    return df.where(F.col(col).isin(list(enabled)))


def lines_to_hosts(df: DataFrame, line_col: str = "line", source_col: str = "source",
                   comment_rule: Column | bool = True) -> DataFrame:
    """Skip empty and ``#`` lines where ``comment_rule`` holds, normalise, drop '', distinct per source."""
    line = F.col(line_col)
    rule = F.lit(comment_rule) if isinstance(comment_rule, bool) else comment_rule
    skip = rule & ((F.coalesce(line, F.lit("")) == "") | line.startswith("#"))
    return (df.where(~skip)
              .select(F.col(source_col).alias("source"), normalize_host(line).alias("host"))
              .where(F.col("host") != "")
              .dropDuplicates(["source", "host"]))


def fallback_lines(df: DataFrame, group: list[str], prio_col: str = "prio", line_col: str = "line") -> DataFrame:
    """Within each group keep only the lines of the best (lowest) ``prio`` whose body is non-empty.

    The choice per group is a small aggregate (partial aggregation map-side, one
    row per group) joined back on (group, prio): no group is ever gathered into
    one task, and AQE broadcasts the tiny choice table at runtime.
    """
    nonempty = F.coalesce(F.col(line_col), F.lit("")) != ""
    choice = df.where(nonempty).groupBy(*group).agg(F.min(prio_col).alias(prio_col))
    return df.join(choice, [*group, prio_col], "left_semi")


def json_feed_hosts(df: DataFrame, body_col: str = "body", source: str = "phishtank",
                    distinct: bool = True) -> DataFrame:
    """A body that is a JSON list; take ``url`` of each item when truthy; malformed -> no rows."""
    is_list = F.regexp_extract(F.col(body_col), r"^\s*(\S)", 1) == "["
    items = F.when(is_list, F.from_json(F.col(body_col), "array<struct<url:string>>"))
    return url_rows_to_hosts(df.select(F.explode(items).alias("item")).select("item.url"), source, distinct)


def url_rows_to_hosts(urls: DataFrame, source: str, distinct: bool = True) -> DataFrame:
    """Rows of one ``url`` each -> tagged hosts."""
    out = (urls.where(F.coalesce(F.col("url"), F.lit("")) != "")
               .select(F.lit(source).alias("source"), normalize_host(F.col("url")).alias("host"))
               .where(F.col("host") != ""))
    return out.dropDuplicates(["source", "host"]) if distinct else out


def csv_feed_hosts(rows: DataFrame, country_col: str = "cc", source: str = "urlhaus_country",
                   distinct: bool = True) -> DataFrame:
    """Parsed CSV rows (``CSV_COLUMNS`` + country code) -> hosts tagged ``<source>:<CC>``.

    Rows whose first field starts with ``#`` are comments; rows with fewer than
    five fields (``host`` null) are skipped.
    """
    keep = ~F.coalesce(F.col("dateadded"), F.lit("")).startswith("#") & F.col("host").isNotNull()
    out = (rows.where(keep)
               .select(F.concat(F.lit(source + ":"), F.upper(F.col(country_col))).alias("source"),
                       normalize_host(F.col("host")).alias("host"))
               .where(F.col("host") != ""))
    return out.dropDuplicates(["source", "host"]) if distinct else out


def parse_csv_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """One CSV record per line (``from_csv``, permissive: missing fields are null)."""
    parsed = F.from_csv(F.col(line_col), CSV_SCHEMA.simpleString(), {"mode": "PERMISSIVE", **CSV_DIALECT})
    return df.withColumn("_csv", parsed).select("*", "_csv.*").drop("_csv")


def ct_hosts(df: DataFrame, value_col: str = "value") -> DataFrame:
    """A10: certificate-update messages -> normalised hosts of ``data.leaf_cert.all_domains``.

    The array is read as ``array<variant>`` so non-string members (numbers,
    nulls) are dropped instead of being cast to strings.
    """
    v = F.try_parse_json(F.col(value_col))
    is_update = F.try_variant_get(v, "$.message_type", "string") == CT_MESSAGE_TYPE
    doms = F.when(is_update, F.try_variant_get(v, "$.data.leaf_cert.all_domains", "array<variant>"))
    strings = F.filter(F.coalesce(doms, F.array().cast("array<variant>")),
                       lambda d: F.schema_of_variant(d) == "STRING")
    out = df.select("*", F.explode(strings).alias("_d"))
    return (out.withColumn("host", normalize_host(F.try_variant_get(F.col("_d"), "$", "string")))
               .drop("_d").where(F.col("host") != ""))


# ---------------------------------------------------------------------------
# File readers (batch and streaming) and the pluggable source registry
# ---------------------------------------------------------------------------

def read_text_feed(spark: SparkSession, path: str, source: str, comment_rule: bool = True) -> DataFrame:
    lines = split_lines(spark.read.text(path))
    return lines_to_hosts(lines.withColumn("source", F.lit(source)), comment_rule=comment_rule)


def read_fallback_feed(spark: SparkSession, path: str, source: str, comment_rule: bool = True) -> DataFrame:
    """A feed with mirrors, landed under ``path/prio=<n>/`` (0 = the primary): the best one that has any line."""
    rows = spark.read.schema("value string, prio int").text(path).withColumn("feed", F.lit(source))
    chosen = fallback_lines(rows, ["feed"], "prio", "value")
    return lines_to_hosts(split_lines(chosen).withColumn("source", F.lit(source)), comment_rule=comment_rule)


def read_json_feed(spark: SparkSession, path: str, source: str = "phishtank") -> DataFrame:
    """One JSON list per file, read element by element: no whole document in one value, at any size.

    A malformed or cut-off document gives no rows.
    """
    rows = spark.read.schema("url string").option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return url_rows_to_hosts(rows, source)


def read_csv_feed(spark: SparkSession, path: str, source: str = "urlhaus_country") -> DataFrame:
    """Country CSVs under ``path/cc=<CC>/``; multi-line quoted fields allowed."""
    rows = (spark.read.schema(T.StructType(CSV_SCHEMA.fields + [T.StructField("cc", T.StringType())]))
                 .options(**CSV_DIALECT).option("multiLine", "true").option("mode", "PERMISSIVE").csv(path))
    return csv_feed_hosts(rows, source=source)


def read_ct_messages(spark: SparkSession, path: str) -> DataFrame:
    return ct_hosts(spark.read.text(path)).select(F.lit("certstream").alias("source"), "host")


def stream_text_feed(spark: SparkSession, path: str, source: str, comment_rule: bool = True) -> DataFrame:
    """Streaming form of ``read_text_feed`` (no per-cycle distinct: the global dedup follows)."""
    lines = split_lines(spark.readStream.format("text").load(path))
    line = F.col("line")
    skip = F.lit(comment_rule) & ((F.coalesce(line, F.lit("")) == "") | line.startswith("#"))
    return (lines.where(~skip).select(F.lit(source).alias("source"), normalize_host(line).alias("host"))
                 .where(F.col("host") != ""))


def stream_ct_messages(spark: SparkSession, path: str) -> DataFrame:
    """A10 streaming: one JSON certificate message per line of the landing files."""
    return ct_hosts(spark.readStream.format("text").load(path)).select(F.lit("certstream").alias("source"), "host")


def stream_json_feed(spark: SparkSession, path: str, source: str = "phishtank") -> DataFrame:
    """A8 streaming: one JSON list per file, read element by element; the global dedup follows."""
    rows = spark.readStream.schema("url string").option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return url_rows_to_hosts(rows, source, distinct=False)


def stream_mirrors(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A7 streaming: (source, host, prio, filled) of the lines of every mirror; ``best_mirror`` chooses in each poll cycle."""
    rows = split_lines(spark.readStream.schema("value string, prio int").format("text").load(path))
    line = F.coalesce(F.col("line"), F.lit(""))
    host = F.when((line == "") | line.startswith("#"), F.lit("")).otherwise(normalize_host(line))
    return rows.select(F.lit(source).alias("source"), host.alias("host"), "prio", (F.coalesce("value", F.lit("")) != "").alias("filled"))


def best_mirror(cycle: DataFrame) -> DataFrame:
    """(source, host) of one poll cycle: of a feed with mirrors the lines of the best one that has any."""
    mirrored = cycle.where(F.col("prio").isNotNull())
    choice = mirrored.where("filled").groupBy("source").agg(F.min("prio").alias("prio"))  # a row for each feed with mirrors
    chosen = mirrored.join(choice, ["source", "prio"], "left_semi").unionByName(cycle.where(F.col("prio").isNull()))
    return chosen.where(F.col("host") != "").select("source", "host")


def stream_csv_feed(spark: SparkSession, path: str, source: str = "urlhaus_country") -> DataFrame:
    """A9 streaming: country CSVs under ``path/cc=<CC>/`` (partition column ``cc``); the global dedup follows."""
    rows = (spark.readStream.schema(T.StructType(CSV_SCHEMA.fields + [T.StructField("cc", T.StringType())]))
                 .options(**CSV_DIALECT).option("multiLine", "true").option("mode", "PERMISSIVE").csv(path))
    return csv_feed_hosts(rows, source=source, distinct=False)


def poll_trigger(sources: Iterable["Source"], enabled: Iterable[str]) -> dict:
    """One streaming query over the union polls at the shortest enabled interval."""
    en = set(enabled)
    secs = [s.interval_s for s in sources if s.name in en and s.interval_s > 0]
    return {"processingTime": f"{min(secs)} seconds"} if secs else {"availableNow": True}


@dataclass(frozen=True)
class Source:
    """A pluggable feed: a name, a reader ``(spark, path) -> DataFrame[source, host]`` and its streaming form."""
    name: str
    read: Callable[[SparkSession, str], DataFrame]
    interval_s: int = 300
    stream: Callable[[SparkSession, str], DataFrame] | None = None
    mirrors: Callable[[SparkSession, str], DataFrame] | None = None


def text_source(name: str, comment_rule: bool = True, interval_s: int = 300) -> Source:
    return Source(name, lambda spark, path: read_text_feed(spark, path, name, comment_rule), interval_s,
                  lambda spark, path: stream_text_feed(spark, path, name, comment_rule))


# Shipped sources, comment rule and poll interval (seconds).
DEFAULT_SOURCES = (
    text_source("openphish", comment_rule=False, interval_s=43200),
    Source("phishtank", lambda s, p: read_json_feed(s, p, "phishtank"), 3600, stream_json_feed),
    text_source("urlhaus", interval_s=300),
    text_source("certpolska", interval_s=300),
    text_source("phishingdatabase", interval_s=86400),
    text_source("phishingarmy", interval_s=21600),
    text_source("botvrij", interval_s=86400),
    # a plain union takes the lines of every mirror; with poll cycles (``streaming.cadence``) the best one is chosen
    Source("digitalside", lambda s, p: read_fallback_feed(s, p, "digitalside"), 86400,
           lambda s, p: stream_text_feed(s, p, "digitalside"), lambda s, p: stream_mirrors(s, p, "digitalside")),
    Source("urlhaus_country", lambda s, p: read_csv_feed(s, p), 600, stream_csv_feed),
    Source("certstream", read_ct_messages, 0, stream_ct_messages),
    text_source("manual", comment_rule=False, interval_s=30),
)


def read_sources(spark: SparkSession, root: str, enabled: Iterable[str],
                 sources: Iterable[Source] = DEFAULT_SOURCES) -> DataFrame:
    """Union of the enabled sources, each read from ``root/<name>``."""
    en = set(enabled)
    dfs = [s.read(spark, f"{root}/{s.name}") for s in sources if s.name in en]
    if not dfs:
        return spark.createDataFrame([], "source string, host string")
    return reduce(DataFrame.unionByName, dfs)


def stream_sources(spark: SparkSession, root: str, enabled: Iterable[str],
                   sources: Iterable[Source] = DEFAULT_SOURCES) -> DataFrame:
    """Streaming union of the enabled sources of every kind (text, JSON, CSV, certificate messages)."""
    en = set(enabled)
    dfs = [s.stream(spark, f"{root}/{s.name}") for s in sources if s.name in en and s.stream]
    if not dfs:
        raise ValueError("no enabled source has a streaming reader")
    return reduce(DataFrame.unionByName, dfs)
