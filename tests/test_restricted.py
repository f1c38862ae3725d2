"""Captures that a batch leaves unread: those of other hosts, few or many, and all where no host is to be judged."""

from pyspark.sql import functions as F

from lurewatch.functions.dates import as_of_lit
from lurewatch.operators import captures as cap
from lurewatch.plans import triage as plan
from lurewatch.plans.triage import Captures, restricted, triage
from lurewatch.rules import TEST_RULES


def pages(spark, names):
    return spark.createDataFrame([(n, "primary", None, 200, {}, "<p>x</p>", [], f"http://{n}", 0.0) for n in names], cap.HTTP_SCHEMA)


def test_many_hosts_leave_other_captures_unparsed(spark, monkeypatch):
    """Beyond the limit of the broadcast list too, other hosts' bodies don't reach the patterns; most hosts take all captures."""
    monkeypatch.setattr(plan, "FEW_HOSTS", 10)
    http = pages(spark, [f"h{i}.com" for i in range(100)] + ["h3.com", None])
    some = spark.range(20).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"))
    got = restricted(Captures(http=http, cert=None), some)
    assert sorted(r.host for r in got.http.select("host").collect()) == sorted([f"h{i}.com" for i in range(20)] + ["h3.com"])
    assert got.cert is None
    most = spark.range(80).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"))
    assert restricted(Captures(http=http), most).http.count() == 102


def test_no_host_to_judge_reads_no_capture(spark):
    """Hosts without a brand or past the gates have their verdict before any capture; a batch of them alone reads none."""
    bad = spark.range(1).select(F.raise_error(F.lit("read")).cast("string").alias("src"), F.lit("x.net.").alias("target"))
    raw = spark.createDataFrame([("elsewhere.example", "manual"), ("Elsewhere.example/x", "urlhaus")], "line string, source string")
    got = triage(raw, Captures(http=pages(spark, ["elsewhere.example"]), cname_records=bad), TEST_RULES, as_of_lit("2026-01-15 12:00:00"))
    assert [(r.host, r.source, r.brand, r.verdict, r.score, r.tally, r.decided_by) for r in got.collect()] == [("elsewhere.example", "manual", None, "irrelevant", None, None, None)]
