"""Golden rows for the Column functions (normalisation, keywords, suffixes, text, dates)."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import dates as dt
from lurewatch.functions import hosts as hosts_fn
from lurewatch.functions import text as tx
from lurewatch.functions.hosts import confusable_distance, contains_any, label_count, normalize_host
from lurewatch.operators.match import brand_of, gate
from lurewatch.operators.suffix import owned_by_brand, registrable_py, with_registrable
from lurewatch.rules import TEST_RULES


def one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("inp,expected", [
    ("example.com", "example.com"), ("https://Example.COM/path?q=1", "example.com"),
    ("*.example.com", "example.com"), ("example.com:8080", "example.com"), ("localhost", ""), ("", ""),
    ("   ", ""), ("exam ple.com", ""), ("EXAMPLE.COM", "example.com"),
    ("http://Sub.Example.COM/page", "sub.example.com"), ("nodot", ""), ("https://example.com:443/", "example.com"),
    ("https://e.com?q=1", ""), ("e.com/x", ""), ("http://u@e.com/", ""), ("# http://evil.com/x", "evil.com"),
    ("*.*.e.com", "*.e.com"), ("1.2.3.4", "1.2.3.4"), ("a_b.com", ""), (None, ""),
    (" example.com ", "example.com"),
])
def test_normalize_host(spark, inp, expected):
    assert one(spark, normalize_host, inp) == expected


def test_contains_any(spark):
    df = spark.createDataFrame([("login-testbrand.com",), ("testbrand.com",), ("",)], "t string")
    got = df.select(contains_any(F.col("t"), ["TestBrand"]).alias("a"), contains_any(F.col("t"), ["", "  "]).alias("b"),
                    contains_any(F.col("t"), []).alias("c")).collect()
    assert [r.a for r in got] == [True, True, False]
    assert not any(r.b or r.c for r in got)


@pytest.mark.parametrize("host,brand", [
    ("phish-testbrand.com", "TestBrand"), ("legitimate-testbrand.com", None), ("unrelated-site.com", None),
    ("", None), ("testbrand.com", "TestBrand"), ("com.testbrandphishing.net", "TestBrand"),
])
def test_brand_match(spark, host, brand):
    assert one(spark, lambda c: brand_of(normalize_host(c), TEST_RULES), host) == brand


@pytest.mark.parametrize("host,expected", [
    ("APP.PAGES.DEV", "dropped"), ("EVILBANK.COM", "scam"), ("", None), ("evilbank.pages.dev", "dropped"),
])
def test_gates(spark, host, expected):
    assert one(spark, lambda c: gate(c, TEST_RULES), host) == expected


def test_registrable(spark):
    rows = [("sub.example.co.uk",), ("example.com",), ("a.b.foo.shop.ck",), ("x.www.ck",), ("w.foo.zz",),
            ("1.2.3.4",), ("co.uk",)]
    df = with_registrable(spark.createDataFrame(rows, "host string"), TEST_RULES)
    got = {r.host: (r.registrable, r.suffix) for r in df.collect()}
    assert got["sub.example.co.uk"] == ("example.co.uk", "co.uk")
    assert got["example.com"] == ("example.com", "com")
    assert got["a.b.foo.shop.ck"] == ("foo.shop.ck", "shop.ck")
    assert got["x.www.ck"] == ("www.ck", "ck")
    assert got["w.foo.zz"] == ("zz", "")
    assert got["1.2.3.4"] == ("1.2.3.4", "")
    assert got["co.uk"] == ("co.uk", "co.uk")
    for h, (reg, suf) in got.items():
        assert registrable_py(h, TEST_RULES)[0] == reg
        assert registrable_py(h, TEST_RULES)[2] == suf


def test_brand_owned(spark):
    df = with_registrable(spark.createDataFrame([("app.testbrand.com",), ("testbrand.com",), ("evil.com",)],
                                                "host string"), TEST_RULES)
    got = {r.host: r.o for r in df.select("host", owned_by_brand(F.col("registrable"), TEST_RULES).alias("o")).collect()}
    assert got == {"app.testbrand.com": True, "testbrand.com": True, "evil.com": False}


def test_looks_base64(spark):
    good = base64.b64encode(b"hello world " * 5).decode()
    assert one(spark, tx.looks_base64, good) is True
    assert one(spark, tx.looks_base64, "abc") is False
    assert one(spark, tx.looks_base64, "!@#$") is False


@pytest.mark.parametrize("a,b,expected", [
    ("same words", "same words", 0.0), ("alpha beta", "gamma delta", 1.0), ("", "", 0.0), ("", "x", 1.0),
    ("hello world", "hello there", 1 - 1 / 3), ("!!", "??", 0.0),
])
def test_content_diff_ratio(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(tx.content_diff_ratio(F.col("a"), F.col("b")).alias("r")).first().r
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("a,b,d", [("abc", "abcd", 1), ("abcd", "abc", 1), ("abc", "axc", 1), ("", "abc", 3), ("", "", 0),
                                   ("а", "a", 0), ("d0s", "dos", 0)])
def test_confusable_distance(spark, a, b, d):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(confusable_distance(F.col("a"), F.col("b")).alias("d")).first().d == d


def test_label_count(spark):
    assert one(spark, label_count, "login.brand.phish.com") == 4
    assert one(spark, label_count, "") == 0


def test_dates(spark):
    as_of = dt.as_of_lit("2026-01-15 12:00:00")
    df = spark.createDataFrame([("2026-01-05T12:00:00Z", "Jan  5 09:34:43 2026 GMT"),
                                ("20260110", "INVALID"), ("2026-01-20", "Nov 10 00:00:00 2025 GMT")],
                               "iso string, cert string")
    got = df.select(dt.age_days(dt.parse_iso(F.col("iso")), as_of).alias("a"),
                    dt.age_days(dt.parse_cert_date(F.col("cert")), as_of).alias("c")).collect()
    assert [r.a for r in got] == [10, 5, -5]
    assert [r.c for r in got] == [10, None, 66]


PSL = "/usr/share/publicsuffix/public_suffix_list.dat"


@pytest.mark.skipif(not __import__("os").path.exists(PSL), reason="no public-suffix list on this machine")
def test_registrable_full_psl(spark):
    from lurewatch.operators.suffix import max_depth
    from lurewatch.rules import suffix_rules_from_psl
    rules = TEST_RULES.with_(suffix_rules=suffix_rules_from_psl(PSL))
    assert len(rules.suffix_rules) > 5000 and max_depth(rules) >= 3
    hosts = ["sub.example.co.uk", "a.b.github.io", "www.example.com", "x.y.kawasaki.jp", "city.kawasaki.jp",
             "foo.bar.ck", "www.ck", "1.2.3.4", "localhost.unknowntld"]
    df = with_registrable(spark.createDataFrame([(h,) for h in hosts], "host string"), rules)
    got = {r.host: r.registrable for r in df.collect()}
    for h in hosts:
        assert got[h] == registrable_py(h, rules)[0], h
    assert got["sub.example.co.uk"] == "example.co.uk"
    assert got["a.b.github.io"] == "github.io"           # private section is off
    assert got["x.y.kawasaki.jp"] == "x.y.kawasaki.jp"   # *.kawasaki.jp wildcard
    assert got["city.kawasaki.jp"] == "city.kawasaki.jp"  # !city.kawasaki.jp exception
    assert got["localhost.unknowntld"] == "unknowntld"


def _codec_form(host):
    try:
        return host.encode("idna").decode("ascii")
    except UnicodeError:
        return host


def test_idna_form_equals_the_codec(spark):
    r = random.Random(3)
    hosts = ["".join(r.choice("abc09-ıſx.") for _ in range(r.randint(1, 30))) for _ in range(400)]
    hosts += ["xn--ı.com", "a" * 60 + "ı.com", "paypal.com", "*.ıa.com.", "ı.com\n", "a..ı", "ı" * 70 + ".com", ".ı", "ı.", "ſ" * 64 + ".de", "ı" * 50 + ".com", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", hosts_fn.idna_host(F.col("host")).alias("form")).collect()
    assert all(x.form == _codec_form(x.host) for x in rows) and len(rows) == len(hosts)
    assert spark.range(1).select(hosts_fn.idna_host(F.lit(None).cast("string")).alias("x")).first().x is None


def test_punycode_of_any_label(spark):
    r = random.Random(5)
    labels = ["".join(r.choice("abz09-ıüß中文\U0001f600é") for _ in range(r.randint(1, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in labels], "label string").select("label", hosts_fn.punycode_label(F.col("label")).alias("code")).collect()
    assert all(x.code == x.label.encode("punycode").decode() for x in rows)
