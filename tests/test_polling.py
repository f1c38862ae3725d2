"""Poll cycles by interval, the mirror of a cycle, certificate history in batches, rules that fail on a host."""

import os
import tempfile

from pyspark.sql import functions as F

from lurewatch.functions.dates import as_of_lit
from lurewatch.operators import captures as cap
from lurewatch.operators.certificates import history_structs, history_table, merge_history, partial_history
from lurewatch.operators.heuristics import DEFAULT_REGISTRY
from lurewatch.operators.python_rules import guarded_rule
from lurewatch.plans.triage import Captures, restricted
from lurewatch.rules import TEST_RULES
from lurewatch.sources import feeds
from lurewatch.streaming.cadence import groups, start_groups, stream_log
from lurewatch.streaming.triage import error_table, start_triage


def put(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_groups_advance_on_their_own_and_a_host_is_triaged_once(spark):
    root = tempfile.mkdtemp(prefix="lw-poll-")
    land, log = os.path.join(root, "landing"), os.path.join(root, "log")
    assert list(groups(["manual", "urlhaus", "digitalside", "certstream"])) == [0, 30, 300, 86400]
    put(land, "manual/a.txt", "one-testbrand.com\n")
    put(land, "digitalside/prio=0/a.txt", "\n")
    put(land, "digitalside/prio=1/a.txt", "one-testbrand.com\n# no\nfive-testbrand.com\n")
    put(land, "digitalside/prio=2/a.txt", "unused.com\n")

    def poll(names):
        for q in start_groups(spark, land, log, os.path.join(root, "polls"), names, once=True).values():
            q.awaitTermination()

    def triage():
        start_triage(spark, stream_log(spark, log), lambda: Captures(), TEST_RULES, as_of_lit("2026-01-15 12:00:00"),
                     os.path.join(root, "sink"), os.path.join(root, "ckpt")).awaitTermination()
        return sorted(r.host for r in spark.read.parquet(os.path.join(root, "sink")).collect())

    poll(["manual", "digitalside"])
    lines = spark.read.parquet(log)
    mirror = sorted(r.host for r in lines.where("source = 'digitalside'").collect())
    assert mirror == sorted(r.host for r in feeds.read_fallback_feed(spark, os.path.join(land, "digitalside"), "digitalside").collect()) == ["five-testbrand.com", "one-testbrand.com"]
    assert triage() == ["five-testbrand.com", "one-testbrand.com"]
    # one group goes on alone; the next cycle chooses anew, and hosts seen before stay triaged once
    put(land, "manual/b.txt", "two-testbrand.com\none-testbrand.com\n")
    poll(["manual"])
    assert triage() == ["five-testbrand.com", "one-testbrand.com", "two-testbrand.com"]
    put(land, "digitalside/prio=0/b.txt", "six-testbrand.com\n")
    put(land, "digitalside/prio=1/b.txt", "seven.com\n")
    poll(["manual", "digitalside"])
    assert triage() == ["five-testbrand.com", "one-testbrand.com", "six-testbrand.com", "two-testbrand.com"]


def message(domains, date):
    return '{"message_type":"certificate_update","data":{"leaf_cert":{"all_domains":%s,"not_before":"%s"}}}' % (str(domains).replace("'", '"'), date)


def test_history_in_batches_equals_one_pass(spark):
    root = tempfile.mkdtemp(prefix="lw-ct-")
    texts = [message([f"a{i % 5}.testbrand.com", "testbrand.com", f"x{i % 3}.org"], f"20{10 + i % 7}-01-01") for i in range(30)] + ["{}", "null", message(["b.org"], "")]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").repartition(3)
    want = {tuple(r) for r in partial_history(rows, TEST_RULES).collect()}
    assert ("testbrand.com", 30, "2010-01-01") in want and ("b.org", 1, None) in want
    table = history_table(spark, root, buckets=4)
    for batch in range(4):
        part = spark.createDataFrame([(t,) for t in texts[batch::4]], "value string")
        for _ in range(2):  # a repeated batch gives the same
            merge_history(table, partial_history(part, TEST_RULES), batch)
    assert {tuple(r) for r in table.read().collect()} == want
    assert {r.registrable: r.ct.cert_count for r in history_structs(table).collect()}["testbrand.com"] == 30


def test_a_failing_host_does_not_hold_up_its_batch(spark):
    root = tempfile.mkdtemp(prefix="lw-fail-")
    land = os.path.join(root, "landing")
    good, bad = "login-testbrand.com", "bad-testbrand.com"
    http = spark.createDataFrame([(h, "primary", None, 404, {}, "", [], f"http://{h}", 0.0) for h in (good, bad)], cap.HTTP_SCHEMA)

    def judge(host):
        if host.startswith("bad"):
            raise KeyError("down")
        return True, "seen"

    registry = (*DEFAULT_REGISTRY, guarded_rule("remote", 0, judge))
    read = []
    for run, text in enumerate([f"{good}\n{bad}\n", "x.com\n", "y.com\n"]):
        put(land, f"manual/{run}.txt", text)
        hs = spark.readStream.format("text").load(f"{land}/manual").select(F.lit("manual").alias("source"), F.col("value").alias("host"))
        start_triage(spark, hs, lambda: Captures(http=http), TEST_RULES, as_of_lit("2026-01-15 12:00:00"), os.path.join(root, "sink"),
                     os.path.join(root, "ckpt"), registry=registry).awaitTermination()
        read.append([(r.host, r.attempts, r.error) for r in error_table(spark, os.path.join(root, "sink")).read().collect()])
    assert read == [[(bad, 1, "remote: KeyError: 'down'")], [(bad, 2, "remote: KeyError: 'down'")], [(bad, 2, "remote: KeyError: 'down'")]]
    assert {r.host: r.verdict for r in spark.read.parquet(os.path.join(root, "sink")).collect()} == {good: "benign", "x.com": "irrelevant", "y.com": "irrelevant"}


def test_tables_of_a_batch_are_removed(spark):
    import pytest

    from lurewatch.sources.store import materialise, passing
    with passing(spark, "test"):
        inside = materialise(spark.range(3), "t")
        path = inside.inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert inside.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
    with pytest.raises(ZeroDivisionError), passing(spark, "test"):
        path = materialise(spark.range(1), "t").inputFiles()[0].removeprefix("file:").removeprefix("//")
        1 / 0
    assert not os.path.exists(path) and materialise(spark.range(1), "t").count() == 1


def test_few_hosts_leave_other_captures_unread(spark):
    http = spark.createDataFrame([(f"h{i}.com", "primary", None, 200, {}, "<p>", [], "", 0.0) for i in range(20)], cap.HTTP_SCHEMA)
    rdap = spark.createDataFrame([("r.com", 200, "{}")], "registrable string, status int, body string")
    few = restricted(Captures(http=http, rdap=rdap), spark.createDataFrame([("h3.com",)], "host string"))
    assert few.http.count() == 1 and few.rdap.count() == 1 and few.cert is None
