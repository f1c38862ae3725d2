"""Capture tables of the driver queries, built from the derived views.

The flat view columns become the typed capture schemas here: the header map
is ``map_from_entries`` of the non-null header columns, the redirect history
is generated from the hop count, favicon bytes are ``encode(content)``.
RDAP and certificate-history views are keyed on ``host``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.plans.triage import Captures
from lurewatch.plans.views import register_views

HEADER_COLUMNS = (("server", "server"), ("strict-transport-security", "hsts"),
                  ("content-security-policy", "csp"), ("x-frame-options", "xfo"),
                  ("x-content-type-options", "xcto"))


def history_of(hops):
    """Hop k (1-based) has status 301 when k is odd, else 302."""
    return F.when(hops > 0, F.transform(F.sequence(F.lit(1), hops),
                                        lambda k: F.when(k % 2 == 1, F.lit(301)).otherwise(F.lit(302)))
                  ).otherwise(F.array().cast("array<int>"))


def http_captures(spark: SparkSession) -> DataFrame:
    v = spark.table("v_http")
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
                                 for k, c in HEADER_COLUMNS]), lambda e: e["value"].isNotNull())
    return v.select("host", "variant", F.concat(F.lit("http://"), F.col("host")).alias("url"),
                    F.col("status").cast("int").alias("status"), F.map_from_entries(entries).alias("headers"),
                    "html", history_of(F.col("hops").cast("int")).alias("history"), "final_url",
                    F.lit(0.0).alias("elapsed_ms"))


def driver_captures(spark: SparkSession, sf_dir: str) -> Captures:
    register_views(spark, sf_dir)
    return Captures(
        http=http_captures(spark),
        dns_records=spark.table("v_dns").select("host", "qname", "rdtype", F.col("pos").cast("int").alias("pos"),
                                                "rdata", F.col("ttl").cast("int").alias("ttl"), "rcode"),
        ptr_records=spark.table("v_ptr"),
        cert=spark.table("v_cert").select("host", "body", "error"),
        rdap=spark.table("v_rdap").select("host", F.col("status").cast("int").alias("status"), "body"),
        favicon=spark.table("v_favicon").select("host", F.col("status").cast("int").alias("status"),
                                                F.encode(F.col("content"), "UTF-8").alias("content")),
        cname_records=spark.table("v_cname").select("src", "target"),
        ct=spark.table("v_ct").select("host", F.col("status").cast("int").alias("status"), "body"),
        rdap_key="host", ct_key="host")


def driver_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir)
    return spark.table("v_pages").select("n", "host")
