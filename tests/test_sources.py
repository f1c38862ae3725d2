"""Feed parsing golden rows, fallback, streaming dedup across restarts, sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from lurewatch.functions.dates import as_of_lit
from lurewatch.plans.triage import Captures
from lurewatch.rules import TEST_RULES
from lurewatch.sources import feeds
from lurewatch.sources.sinks import read_verdicts, write_verdicts
from lurewatch.streaming.triage import start_triage, stream_hosts


def hosts(df):
    return sorted(r.host for r in df.collect())


def test_text_feeds(spark):
    lines = ["# comment", "not-a-domain", "valid.example.com", "", "https://SCAM.EXAMPLE.COM/path", "# http://x.com/a"]
    df = spark.createDataFrame([(ln,) for ln in lines], "line string").withColumn("source", F.lit("urlhaus"))
    assert hosts(feeds.lines_to_hosts(df)) == ["scam.example.com", "valid.example.com"]
    # no comment rule (openphish / manual): a commented URL is accepted
    assert "x.com" in hosts(feeds.lines_to_hosts(df, comment_rule=False))


def test_fallback(spark):
    rows = [(0, 0, ""), (0, 1, "fallback-domain.com"), (1, 0, "primary.com"), (1, 1, "mirror.com")]
    df = spark.createDataFrame(rows, "cycle int, prio int, line string")
    got = sorted((r.cycle, r.line) for r in feeds.fallback_lines(df, ["cycle"]).where("line <> ''").collect())
    assert got == [(0, "fallback-domain.com"), (1, "primary.com")]


def test_json_feed(spark):
    bodies = ['[{"no_url":true},{"url":"http://valid.com/"},{"url":"http://dup.com/a"},{"url":"http://dup.com/b"}]',
              "not json", '{"url":"http://obj.com/"}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert hosts(feeds.json_feed_hosts(df)) == ["dup.com", "valid.com"]


def test_csv_feed(spark):
    lines = ['"2026-01-01 00:00:00","http://evil.sg/path","online","malware_download","evil.sg","1.2.3.4","AS1234","SG"',
             "only,four,fields,here", '"# comment","x","y","z","commented.sg","a","b","SG"']
    df = feeds.parse_csv_lines(spark.createDataFrame([(ln, "sg") for ln in lines], "line string, cc string"))
    out = feeds.csv_feed_hosts(df).collect()
    assert [(r.source, r.host) for r in out] == [("urlhaus_country:SG", "evil.sg")]


def test_ct_messages(spark):
    msgs = ['{"message_type":"certificate_update","data":{"leaf_cert":{"all_domains":["*.EVIL.COM"]}}}',
            '{"message_type":"heartbeat"}', "null", '"plain"',
            '{"message_type":"certificate_update","data":{}}',
            '{"message_type":"certificate_update","data":{"leaf_cert":{"all_domains":[null,123,"good.com"]}}}']
    df = spark.createDataFrame([(m,) for m in msgs], "value string")
    assert hosts(feeds.ct_hosts(df)) == ["evil.com", "good.com"]


def test_stream_dedup_survives_restart(spark):
    root = tempfile.mkdtemp(prefix="lw-stream-")
    land = os.path.join(root, "landing", "manual")
    os.makedirs(land)
    with open(os.path.join(land, "a.txt"), "w") as fh:
        fh.write("phish-testbrand.com\nphish-testbrand.com\nother.com\nevilbank-testbrand.com\n")

    def run():
        hs = stream_hosts(spark, os.path.join(root, "landing"), [("manual", False)])
        q = start_triage(spark, hs, lambda: Captures(), TEST_RULES, as_of_lit("2026-01-15 12:00:00"),
                         os.path.join(root, "sink"), os.path.join(root, "ckpt"))
        q.awaitTermination()

    run()
    with open(os.path.join(land, "b.txt"), "w") as fh:
        fh.write("phish-testbrand.com\nnew-testbrand.com\n")
    run()  # restart on the same checkpoint: state keeps phish-testbrand.com
    out = spark.read.parquet(os.path.join(root, "sink")).collect()
    got = sorted((r.host, r.verdict) for r in out)
    assert got == [("evilbank-testbrand.com", "scam"), ("new-testbrand.com", "pending"),
                   ("other.com", "irrelevant"), ("phish-testbrand.com", "pending")]


def test_sink_roundtrip(spark):
    rows = [("a-testbrand.com", "TestBrand", "scam"), ("b.com", None, "irrelevant"), ("c-testbrand.com", "TestBrand", None)]
    df = spark.createDataFrame(rows, "host string, brand string, verdict string")
    root = tempfile.mkdtemp(prefix="lw-sink-")
    write_verdicts(df, root, fmt="text")
    got = sorted(tuple(r) for r in read_verdicts(spark, root, fmt="text").collect())
    assert got == [("a-testbrand.com", "TestBrand", "scam"), ("b.com", None, "irrelevant")]
    assert os.path.isdir(os.path.join(root, "brands", "brand=TestBrand", "verdict=scam"))


def test_one_row_per_key(spark):
    from lurewatch.operators.captures import cert_fields, latest_per_key
    rows = [("h.com", '{"subject":[[["commonName","old"]]]}', None, "2026-01-01 00:00:00"),
            ("h.com", '{"subject":[[["commonName","new"]]]}', None, "2026-01-02 00:00:00"),
            ("g.com", '{"subject":[[["commonName","g"]]]}', None, "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "host string, body string, error string, captured_at string") \
        .withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    got = {r.host: r.cert.cn for r in cert_fields(df).collect()}
    assert got == {"h.com": "new", "g.com": "g"}
    assert latest_per_key(df.drop("captured_at"), "host").count() == 2


def test_stream_with_captures(spark):
    """Each micro-batch joins the latest capture tables; hosts with a capture get a real verdict."""
    from lurewatch.operators import captures as cap
    root = tempfile.mkdtemp(prefix="lw-stream2-")
    land = os.path.join(root, "landing", "urlhaus")
    os.makedirs(land)
    with open(os.path.join(land, "a.txt"), "w") as fh:
        fh.write("# comment\nhttps://login-testbrand.com/x\nwait-testbrand.com\n")
    http = spark.createDataFrame(
        [("login-testbrand.com", "primary", None, 404, {}, "", [], "http://login-testbrand.com", 0.0)],
        cap.HTTP_SCHEMA)
    hs = stream_hosts(spark, os.path.join(root, "landing"), [("urlhaus", True)])
    q = start_triage(spark, hs, lambda: Captures(http=http), TEST_RULES, as_of_lit("2026-01-15 12:00:00"),
                     os.path.join(root, "sink"), os.path.join(root, "ckpt"))
    q.awaitTermination()
    got = sorted((r.host, r.verdict, r.source) for r in spark.read.parquet(os.path.join(root, "sink")).collect())
    assert got == [("login-testbrand.com", "benign", "urlhaus"), ("wait-testbrand.com", "pending", "urlhaus")]


def test_file_readers(spark):
    root = tempfile.mkdtemp(prefix="lw-feeds-")

    def put(rel, text):
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as fh:
            fh.write(text)

    put("urlhaus/a.txt", "# c\nhttps://SCAM.EXAMPLE.COM/path\n\nscam.example.com\n")
    put("openphish/a.txt", "# http://commented.com/x\x0bsecond.com\n")
    put("phishtank/a.json", '[{"url":"http://valid.com/"},{"no_url":1}]')
    put("urlhaus_country/cc=SG/a.csv",
        '"2026-01-01","http://evil.sg/p","online","m","evil.sg","1.2.3.4","AS1","SG"\n'
        '"# c","x","y","z","c.sg","a","b","SG"\nonly,four,fields,here\n')
    put("certstream/a.txt", '{"message_type":"certificate_update","data":{"leaf_cert":{"all_domains":["*.ct.com"]}}}\n')
    enabled = ["urlhaus", "openphish", "phishtank", "urlhaus_country", "certstream"]
    got = sorted((r.source, r.host) for r in feeds.read_sources(spark, root, enabled).collect())
    assert got == [("certstream", "ct.com"), ("openphish", "commented.com"), ("openphish", "second.com"),
                   ("phishtank", "valid.com"), ("urlhaus", "scam.example.com"),
                   ("urlhaus_country:SG", "evil.sg")]


def test_redirect_history(spark):
    from lurewatch.operators.captures import redirect_history
    hops = spark.createDataFrame([("h", "primary", 2, 302), ("h", "primary", 1, 301)],
                                 "host string, variant string, hop int, status int")
    assert redirect_history(hops).first().history == [301, 302]


def test_python_rule_in_registry(spark):
    from lurewatch.functions.dates import as_of_lit
    from lurewatch.operators.heuristics import DEFAULT_REGISTRY
    from lurewatch.operators.python_rules import idna_punycode_rule
    from lurewatch.operators.verdict import evaluate_rules
    from tests.test_rules import make
    reg = tuple(idna_punycode_rule() if r.name == "punycode" else r for r in DEFAULT_REGISTRY)
    idx = [r.name for r in reg].index("punycode") + 1
    for host, fires in (("xn--dbs-abc.com", True), ("login.xn--dbs.com", True), ("evil-testbrand.com", False)):
        ev = evaluate_rules(make(spark, host=host), TEST_RULES, as_of_lit("2026-01-15 12:00:00"), reg).first()
        assert ev[f"__rule_{idx:02d}"].suspicious is fires


def test_ct_history_cases(spark):
    from lurewatch.operators.captures import ct_history
    rows = [("a", 200, '[{"not_before":"2024-01-01"},{"entry_timestamp":"2023-06-15"}]'), ("b", 503, ""),
            ("c", 200, "not-json"), ("d", 200, '{"error":"x"}'), ("e", 200, "[1, 2]"), ("f", 200, "[]")]
    df = spark.createDataFrame(rows, "registrable string, status int, body string")
    got = {r.registrable: (r.ct.cert_count, r.ct.earliest_date, r.ct.error is not None)
           for r in ct_history(df).collect()}
    assert got == {"a": (2, "2023-06-15", False), "b": (0, None, True), "c": (0, None, True),
                   "d": (0, None, False), "e": (0, None, True), "f": (0, None, False)}


def test_streaming_readers(spark):
    root = tempfile.mkdtemp(prefix="lw-sread-")
    for rel, text in (("ct/a.txt", '{"message_type":"certificate_update","data":{"leaf_cert":{"all_domains":'
                                   '["*.S1.com",7]}}}\n{"message_type":"heartbeat"}\n'),
                      ("pt/a.json", '[{"url":"http://s2.com/x"},{"url":""}]'),
                      ("cc/cc=MY/a.csv", '"d","u","s","t","s3.my","i","a","MY"\n"# x","u","s","t","no.my","i","a","MY"\n')):
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as fh:
            fh.write(text)
    union = (feeds.stream_ct_messages(spark, f"{root}/ct")
             .unionByName(feeds.stream_json_feed(spark, f"{root}/pt"))
             .unionByName(feeds.stream_csv_feed(spark, f"{root}/cc")))
    q = union.writeStream.format("memory").queryName("lw_sread").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.source, r.host) for r in spark.table("lw_sread").collect())
    assert got == [("certstream", "s1.com"), ("phishtank", "s2.com"), ("urlhaus_country:MY", "s3.my")]
    assert feeds.poll_trigger(feeds.DEFAULT_SOURCES, ["urlhaus", "openphish"]) == {"processingTime": "300 seconds"}


def test_seen_hosts_and_bounded_dedup(spark):
    from lurewatch.plans.triage import dedup_hosts
    df = spark.createDataFrame([("a.com", "x"), ("a.com", "y"), ("b.com", "x"), ("c.com", "z")],
                               "host string, source string")
    seen = spark.createDataFrame([("b.com",)], "host string")
    assert hosts(dedup_hosts(df, seen)) == ["a.com", "c.com"]
    root = tempfile.mkdtemp(prefix="lw-wm-")
    land = os.path.join(root, "landing", "manual")
    os.makedirs(land)
    with open(os.path.join(land, "a.txt"), "w") as fh:
        fh.write("x-testbrand.com\nx-testbrand.com\ny.com\n")
    hs = stream_hosts(spark, os.path.join(root, "landing"), [("manual", False)])
    q = start_triage(spark, hs, lambda: Captures(), TEST_RULES, as_of_lit("2026-01-15 12:00:00"),
                     os.path.join(root, "sink"), os.path.join(root, "ckpt"), forget_after="30 days")
    q.awaitTermination()
    got = sorted((r.host, r.verdict) for r in spark.read.parquet(os.path.join(root, "sink")).collect())
    assert got == [("x-testbrand.com", "pending"), ("y.com", "irrelevant")]


def test_csv_dialect_and_json_reader(spark):
    """Doubled quotes, a trailing backslash, a multi-line field; a JSON list read element by element."""
    root = tempfile.mkdtemp(prefix="lw-csv-")
    os.makedirs(os.path.join(root, "csv", "cc=SG"))
    with open(os.path.join(root, "csv", "cc=SG", "a.csv"), "w", encoding="utf-8") as fh:
        fh.write('"2026","http://x/""q""/","online","malware","evil-one.com","1.1.1.1","AS1","SG"\n'
                 '"2026","http://y/\\","online","malware","evil-two.com","1.1.1.2","AS1","SG"\n'
                 '"2026","http://z/\nnext","online","malware","evil-three.com","1.1.1.3","AS1","SG"\n')
    assert hosts(feeds.read_csv_feed(spark, os.path.join(root, "csv"))) == ["evil-one.com", "evil-three.com", "evil-two.com"]
    line = spark.createDataFrame([('"2026","http://x/""q""/\\","online","m","evil-four.com"',)], "line string")
    assert feeds.parse_csv_lines(line).first().host == "evil-four.com"
    for name, text in (("good", '[{"url":"http://a.com/"},\n{"url":null},{"x":1},{"url":"b.org"}]'), ("cut", '[{"url":"http://c.com/"},')):
        os.makedirs(os.path.join(root, name))
        with open(os.path.join(root, name, "f.json"), "w", encoding="utf-8") as fh:
            fh.write(text)
    assert hosts(feeds.read_json_feed(spark, os.path.join(root, "good"))) == ["a.com", "b.org"]


def test_pending_hosts_are_taken_up_again(spark):
    """A host seen before its capture gets its verdict in the batch after the capture; a replayed batch changes nothing."""
    from lurewatch.operators import captures as cap
    from lurewatch.sources.sinks import read_verdicts
    from lurewatch.streaming.triage import latest_verdicts, settle
    root = tempfile.mkdtemp(prefix="lw-pending-")
    land = os.path.join(root, "landing", "manual")
    os.makedirs(land)
    http = spark.createDataFrame(
        [("login-testbrand.com", "primary", None, 404, {}, "", [], "http://login-testbrand.com", 0.0)], cap.HTTP_SCHEMA)

    def run(name, text, captures):
        with open(os.path.join(land, name), "w") as fh:
            fh.write(text)
        hs = stream_hosts(spark, os.path.join(root, "landing"), [("manual", False)])
        start_triage(spark, hs, lambda: captures, TEST_RULES, as_of_lit("2026-01-15 12:00:00"),
                     os.path.join(root, "sink"), os.path.join(root, "ckpt")).awaitTermination()

    run("a.txt", "login-testbrand.com\nwait-testbrand.com\n", Captures())
    run("b.txt", "login-testbrand.com\nother.com\n", Captures(http=http))
    got = {r.host: r.verdict for r in latest_verdicts(spark, os.path.join(root, "sink")).collect()}
    assert got == {"login-testbrand.com": "benign", "wait-testbrand.com": "pending", "other.com": "irrelevant"}
    settle(spark, os.path.join(root, "sink"), os.path.join(root, "out"))
    assert {r.host: r.verdict for r in read_verdicts(spark, os.path.join(root, "out")).collect()} == got


def test_repeated_captures_latest_wins(spark):
    from lurewatch.operators import captures as cap
    rows = [("h.com", 503, None, 1), ("h.com", 200, '{"events":[{"eventAction":"registration","eventDate":"2025-01-01"}]}', 2),
            ("g.com", 200, "[]", 1), ("b.com", 200, "{", 1)]
    rdap = spark.createDataFrame(rows, "registrable string, status int, body string, captured_at int")
    got = {r.registrable: r.registration for r in cap.rdap_fields(rdap).collect()}
    assert (got["h.com"].created, got["h.com"].error) == ("2025-01-01", None)
    assert got["g.com"].error == "unexpected json" and got["b.com"].error == "invalid json"
    ptr = spark.createDataFrame([("10.0.0.1", "a.net."), ("10.0.0.1", "a.net."), ("10.0.0.1", "b.net.")], "ip string, target string")
    snap = spark.createDataFrame([("h.com", ["10.0.0.1", "10.0.0.2"])], "host string, a_records array<string>")
    assert cap.ptr_rollup(snap, ptr).first().ptr_records == ["a.net.", "b.net."]


def test_five_thousand_brands(spark):
    from lurewatch.operators.match import match_brand
    from lurewatch.rules import Brand
    many = TEST_RULES.with_(brands=tuple(Brand(i, f"Brand {i}", (f"brand{i}.com",), (f"brand{i}x",), ()) for i in range(5000)))
    df = spark.createDataFrame([("a-brand4999x.com",), ("none.com",), ("brand7x-brand3x.org",), (None,)], "host string")
    assert [r.brand for r in match_brand(df, many).collect()] == ["Brand 4999", None, "Brand 3", None]


def test_stream_of_all_kinds_and_fallback(spark):
    root = tempfile.mkdtemp(prefix="lw-kinds-")

    def put(rel, text):
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as fh:
            fh.write(text)

    put("manual/a.txt", "one-testbrand.com\n")
    put("phishtank/a.json", '[{"url":"http://two-testbrand.com/"}]')
    put("urlhaus_country/cc=SG/a.csv", '"2026","u","on","m","three-testbrand.com","1","2","SG"\n')
    put("certstream/a.txt", '{"message_type":"certificate_update","data":{"leaf_cert":{"all_domains":["four-testbrand.com"]}}}\n')
    put("digitalside/prio=0/a.txt", "\n")
    put("digitalside/prio=1/a.txt", "five-testbrand.com\n# no\n")
    put("digitalside/prio=2/a.txt", "unused.com\n")
    names = ["manual", "phishtank", "urlhaus_country", "certstream"]
    start_triage(spark, feeds.stream_sources(spark, root, names), lambda: Captures(), TEST_RULES, as_of_lit("2026-01-15 12:00:00"),
                 os.path.join(root, "sink"), os.path.join(root, "ckpt")).awaitTermination()
    got = sorted((r.host, r.source) for r in spark.read.parquet(os.path.join(root, "sink")).collect())
    assert got == [("four-testbrand.com", "certstream"), ("one-testbrand.com", "manual"), ("three-testbrand.com", "urlhaus_country:SG"), ("two-testbrand.com", "phishtank")]
    assert hosts(feeds.read_sources(spark, root, ["digitalside"])) == ["five-testbrand.com"]


def test_registrable_join_deals_hot_keys(spark):
    """RDAP and certificate history keyed on the registrable: right rows, and a hot one in several tasks."""
    from lurewatch.operators.skew import heavy_keys, join_by_count
    from lurewatch.plans.triage import build_context
    hosts_ = spark.createDataFrame([(f"h{i}.testbrand.com",) for i in range(300)] + [("a.other.com",), ("b.none.com",)], "host string")
    rdap = spark.createDataFrame([("testbrand.com", 404, None), ("other.com", 500, None)], "registrable string, status int, body string")
    ct = spark.createDataFrame([("testbrand.com", 200, '[{"not_before":"2024-01-01"}]')], "registrable string, status int, body string")
    rows = {r.host: r for r in build_context(hosts_, Captures(rdap=rdap, ct=ct), TEST_RULES).select("host", "registration", "ct").collect()}
    assert len(rows) == 302 and all(rows[f"h{i}.testbrand.com"].ct.cert_count == 1 and rows[f"h{i}.testbrand.com"].registration.error == "http_status=404" for i in range(300))
    assert rows["a.other.com"].registration.error == "http_status=500" and rows["a.other.com"].ct is None and rows["b.none.com"].registration is None
    keyed = hosts_.withColumn("registrable", F.lit("testbrand.com"))
    joined = join_by_count(keyed, ct.select("registrable", "status").hint("merge"), "registrable", "host", tasks=8)
    # only keys beyond a fair share are repeated, as often as their count asks for
    mixed = keyed.unionByName(spark.range(700).select(F.concat(F.lit("x"), "id").alias("host"), F.concat(F.lit("r"), F.col("id") % 100).alias("registrable")))
    assert [(r.registrable, r._shares) for r in heavy_keys(mixed, "registrable", 8).collect()] == [("testbrand.com", 3)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = joined.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joined.count() == 302 and tasks >= 3
