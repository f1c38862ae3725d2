"""Driver queries: one Spark plan per operator group and its DuckDB oracle.

Every query reads the driver tables through the derived views of
``plans.views`` (whole tables, no row subsets) and returns a DataFrame whose
column names match the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import text as tx
from lurewatch.functions.dates import as_of_lit
from lurewatch.functions.hosts import is_punycode, label_count, normalize_host
from lurewatch.operators import heuristics as H
from lurewatch.operators.features import with_page_features
from lurewatch.operators.heuristics import RuleContext, lookalike_best
from lurewatch.operators.match import gate, is_auto_scam, is_trusted
from lurewatch.operators.suffix import owned_by_brand, with_registrable
from lurewatch.plans import oracle as O
from lurewatch.plans.views import register_views, with_views
from lurewatch.rules import DRIVER_AS_OF, DRIVER_RULES, Brand

R = DRIVER_RULES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle_sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = with_views(oracle_sql, views)
        return fn
    return deco


def _v(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_views(spark, sf_dir)
    return spark.table(name)


def _as_of():
    return as_of_lit(DRIVER_AS_OF)


# ---------------------------------------------------------------------------
# Hosts: normalisation, feeds, brand attribution, gates, suffixes
# ---------------------------------------------------------------------------

@query("normalize_hosts", f"""
SELECT n, host FROM (SELECT n, {O.norm_sql('line')} AS host FROM v_raw) t WHERE host <> ''""", ("v_raw",))
def q_normalize_hosts(spark, sf_dir):
    raw = _v(spark, sf_dir, "v_raw")
    return raw.select("n", normalize_host(F.col("line")).alias("host")).where(F.col("host") != "")


# feed of each line: openphish has no comment rule; the others skip '#' lines; certpolska is disabled
_FEED_SQL = "CASE n % 3 WHEN 0 THEN 'openphish' WHEN 1 THEN 'urlhaus' ELSE 'certpolska' END"
_ENABLED = ("openphish", "urlhaus")


@query("feed_lines", f"""
SELECT DISTINCT source, host FROM (
  SELECT {_FEED_SQL} AS source, line, {O.norm_sql('line')} AS host FROM v_raw) t
WHERE source IN ('openphish', 'urlhaus') AND host <> ''
  AND (source = 'openphish' OR NOT (coalesce(line, '') = '' OR starts_with(line, '#')))""", ("v_raw",))
def q_feed_lines(spark, sf_dir):
    from lurewatch.sources.feeds import lines_to_hosts, select_sources
    raw = _v(spark, sf_dir, "v_raw").withColumn("source", F.expr(_FEED_SQL))
    raw = select_sources(raw, _ENABLED)
    return lines_to_hosts(raw, comment_rule=F.col("source") != "openphish")


@query("brand_match", f"""
SELECT n, host, {O.brand_sql('host', R)} AS brand, {O.brand_sql('host', R, 'ord')} AS brand_ord FROM v_hosts""",
       ("v_hosts",))
def q_brand_match(spark, sf_dir):
    from lurewatch.operators.match import match_brand
    return match_brand(_v(spark, sf_dir, "v_hosts"), R).select("n", "host", "brand", "brand_ord")


@query("gates", f"""
SELECT n, host, tr AS trusted, au AS auto_scam,
  CASE WHEN tr THEN 'dropped' WHEN au THEN 'scam' END AS gate
FROM (SELECT n, host, {O.contains_any_sql('lower(host)', R.trusted_l, False)} AS tr,
             {O.contains_any_sql('lower(host)', R.auto_scam_l, False)} AS au FROM v_hosts) t""", ("v_hosts",))
def q_gates(spark, sf_dir):
    h = F.col("host")
    return _v(spark, sf_dir, "v_hosts").select("n", "host", is_trusted(h, R).alias("trusted"),
                                               is_auto_scam(h, R).alias("auto_scam"), gate(h, R).alias("gate"))


@query("registrable", f"""
WITH reg AS ({O.registrable_cte(R, 'v_hosts')})
SELECT v.n, v.host, reg.registrable, reg.suffix FROM v_hosts v JOIN reg ON reg.host = v.host""", ("v_hosts",))
def q_registrable(spark, sf_dir):
    return with_registrable(_v(spark, sf_dir, "v_hosts"), R).select("n", "host", "registrable", "suffix")


def _owner_sql(reg: str) -> str:
    parts = [f"WHEN {O.owned_sql(reg, R, b.ord)} THEN {O.q(b.name)}" for b in R.brands]
    return "CASE " + " ".join(parts) + " END"


@query("brand_owned", f"""
WITH reg AS ({O.registrable_cte(R, 'v_hosts')})
SELECT v.n, v.host, {O.owned_sql('reg.registrable', R)} AS owned, {_owner_sql('reg.registrable')} AS owner
FROM v_hosts v JOIN reg ON reg.host = v.host""", ("v_hosts",))
def q_brand_owned(spark, sf_dir):
    from lurewatch.operators.suffix import with_owner
    df = with_owner(with_registrable(_v(spark, sf_dir, "v_hosts"), R), R)
    return df.select("n", "host", owned_by_brand(F.col("registrable"), R).alias("owned"), "owner")


@query("label_count", f"""
SELECT n, host, CAST(len(list_filter(string_split(host, '.'), lambda x: x <> '')) AS INTEGER) AS label_count,
  len(list_filter(string_split(host, '.'), lambda x: x <> '')) >= {R.thresholds.subdomain_min_depth} AS deep
FROM v_hosts""", ("v_hosts",))
def q_label_count(spark, sf_dir):
    n = label_count(F.col("host"))
    return _v(spark, sf_dir, "v_hosts").select("n", "host", n.alias("label_count"),
                                               (n >= R.thresholds.subdomain_min_depth).alias("deep"))


@query("punycode", """
SELECT n, host, (starts_with(host, 'xn--') OR contains(host, '.xn--') OR contains(host, 'ı')) AS punycode
FROM v_hosts""", ("v_hosts",))
def q_punycode(spark, sf_dir):
    return _v(spark, sf_dir, "v_hosts").select("n", "host", is_punycode(F.col("host")).alias("punycode"))


@query("suspicious_tld", f"""
WITH reg AS ({O.registrable_cte(R, 'v_hosts')})
SELECT v.n, v.host, reg.suffix, coalesce(lower(reg.suffix) IN ({', '.join(O.q(t) for t in R.suspicious_tlds)}), false)
  AS suspicious_tld
FROM v_hosts v JOIN reg ON reg.host = v.host""", ("v_hosts",))
def q_suspicious_tld(spark, sf_dir):
    df = with_registrable(_v(spark, sf_dir, "v_hosts"), R)
    return df.select("n", "host", "suffix", F.lower("suffix").isin(list(R.suspicious_tlds)).alias("suspicious_tld"))


@query("lookalike", f"""
WITH reg AS ({O.registrable_cte(R, 'v_hosts')}),
cands AS (
  SELECT v.n, v.host, 0 AS ci, lower(v.host) AS cand FROM v_hosts v
  UNION ALL
  SELECT v.n, v.host, 1 AS ci, lower(CASE WHEN reg.registrable <> '' THEN reg.registrable ELSE v.host END)
  FROM v_hosts v JOIN reg ON reg.host = v.host),
d AS (
  SELECT c.n, c.host, lt.b_ord, c.ci, lt.pos, lt.kind, lt.target,
    levenshtein(CASE WHEN lt.kind = 'name' THEN {O.skeleton_sql('c.cand')}
                     ELSE {O.skeleton_sql("split_part(c.cand, '.', 1)")} END, lt.skel) AS dist
  FROM cands c CROSS JOIN {O.lookalike_targets_values(R)}),
best AS (
  SELECT n, arg_min(kind, [dist, b_ord, ci, pos]) AS kind, arg_min(target, [dist, b_ord, ci, pos]) AS target,
         CAST(min(dist) AS INTEGER) AS dist
  FROM d WHERE dist <= {R.thresholds.lookalike_max_distance} GROUP BY n)
SELECT v.n, v.host, best.dist, best.kind, best.target, best.n IS NOT NULL AS lookalike
FROM v_hosts v LEFT JOIN best ON best.n = v.n""", ("v_hosts",))
def q_lookalike(spark, sf_dir):
    df = with_registrable(_v(spark, sf_dir, "v_hosts"), R)
    best = lookalike_best(F.col("host"), F.col("registrable"), R)
    lim = R.thresholds.lookalike_max_distance
    return df.select("n", "host", best.alias("b")).select(
        "n", "host", F.col("b.dist").alias("dist"), F.col("b.kind").alias("kind"), F.col("b.target").alias("target"),
        F.coalesce(F.col("b.dist") <= lim, F.lit(False)).alias("lookalike"))


# ---------------------------------------------------------------------------
# Page rules over v_pages
# ---------------------------------------------------------------------------

def _materialised(spark, sf_dir: str, tag: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build once per data directory, write to the shared checkpoint folder, read back.

    Shared enrichment (page features, host context) is computed once and read by
    every report that needs it; the written table also cuts lineage, so a lost
    executor never recomputes the enrichment.
    """
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()

    def status(path: str):
        found = jvm.org.apache.hadoop.fs.Path(path)
        files = found.getFileSystem(conf)
        return files.getFileStatus(found).getModificationTime() if files.exists(found) else None

    key = (spark.sparkContext.applicationId, sf_dir, tag, status(f"{sf_dir}/pages.parquet"))
    path = _MATERIALISED.get(key)
    if path is None or status(path) is None:
        path = _scratch(spark, tag)
        build().write.parquet(path)
        _MATERIALISED[key] = path
    return spark.read.parquet(path)


_MATERIALISED: dict[tuple, str] = {}


def _pages_features(spark, sf_dir) -> DataFrame:
    def build():
        pages = _v(spark, sf_dir, "v_pages")
        return with_page_features(pages, R, html_col="html", host_col="host", out="f")
    return _materialised(spark, sf_dir, "page-features", build)


_PF = f"""pf AS (
  SELECT n, host, final_url, html, lower(html) AS lo,
         regexp_extract_all(lower(html), '{O.WORD}+') AS words FROM v_pages)"""

_PASSWORD = "regexp_matches(html, '(?i)type=[\"'']?password[\"'']?')"
_OTP = f"regexp_matches(html, '(?i)(2fa|otp|one[-{O.WS}]?time)')"
_CARD = "regexp_matches(html, '(?i)(card number|ccnum|cvv|cvc)')"
_EXFIL = ("(regexp_matches(html, '(?i)(mailto:|sendmail\\.php|wp-mail|phpmail|smtp)') OR "
          "regexp_matches(html, '(?i)(t\\.me/|telegram\\.(me|org)|bot_token|api\\.telegram\\.org)') OR "
          "regexp_matches(html, '(?i)(discord\\.gg|discord\\.com/api/webhooks)'))")
_JS = f"regexp_matches(html, '(^|[^\\p{{L}}\\p{{N}}_])(atob|eval|Function\\()|fromCharCode\\(')"
_WALLET = "regexp_matches(html, '(window\\.ethereum|eth_requestAccounts|web3|eth_sign|walletconnect)')"
_CLIP = "(contains(lo, 'clipboard') AND regexp_matches(html, '(replace|execCommand|writeText)'))"
_KIT = "regexp_matches(lo, '(?i)(phishing kit|by .* phisher|tg://|t\\.me/)')"
_ENTROPY = ("len(list_filter(regexp_extract_all(html, '[A-Za-z0-9+/=]{40,}'), lambda s: length(s) > 64 AND "
            "regexp_full_match(s, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?'))) > 0")
_ACTIONS = f"regexp_extract_all(html, '(?i)<form[^>]*action=[\"'']?([^\"''>{O.WS}]+)', 1)"
_XPOST = (f"len(list_filter({_ACTIONS}, lambda a: contains(a, '://') AND {O.norm_sql('a')} <> '' AND host <> '' "
          f"AND {O.norm_sql('a')} <> host AND NOT starts_with(a, '#'))) > 0")
_TITLE_RE = "(?is)<title[^>]*>(.*?)</title>"


@query("forms_exfil", f"""
WITH {_PF}, b AS (
  SELECT n, host, {_PASSWORD} AS password, {_OTP} AS otp, {_CARD} AS card, {_XPOST} AS cross_post,
         {_EXFIL} AS exfil, {_JS} AS js_obf, {_ENTROPY} AS high_entropy, {_WALLET} AS wallet, {_CLIP} AS clipboard
  FROM pf)
SELECT *, CASE WHEN (password OR card) AND (exfil OR cross_post) THEN 'scam'
               WHEN password OR otp OR card OR js_obf OR high_entropy OR wallet OR clipboard THEN 'suspicious' END
          AS outcome
FROM b""", ("v_pages",))
def q_forms_exfil(spark, sf_dir):
    df = _pages_features(spark, sf_dir)
    cols = ["password", "otp", "card", "cross_post", "exfil", "js_obf", "high_entropy", "wallet", "clipboard"]
    r = H.forms_and_exfil(RuleContext(R, _as_of()))
    out = df.withColumn("primary", F.struct(F.col("f").alias("f")))
    return out.select("n", "host", *[F.col("f")[c].alias(c) for c in cols],
                      F.when(r["scam"], "scam").when(r["suspicious"], "suspicious").alias("outcome"))


@query("phishing_kit", f"""
WITH {_PF}, b AS (
  SELECT n, {_KIT} AS kit_comment,
         {O.contains_any_sql('lower(final_url)', R.kit_paths, False)} AS path_hit FROM pf)
SELECT n, kit_comment, path_hit,
       CASE WHEN kit_comment THEN 'scam' WHEN path_hit THEN 'suspicious' END AS outcome FROM b""", ("v_pages",))
def q_phishing_kit(spark, sf_dir):
    df = _pages_features(spark, sf_dir).withColumn("primary", F.struct("final_url", "f"))
    r = H.phishing_kit(RuleContext(R, _as_of()))
    from lurewatch.functions.hosts import contains_any
    return df.select("n", F.col("f.kit_comment").alias("kit_comment"),
                     contains_any(F.lower("final_url"), R.kit_paths, normalise=False).alias("path_hit"),
                     F.when(r["scam"], "scam").when(r["suspicious"], "suspicious").alias("outcome"))


@query("base64_runs", f"""
SELECT n, CAST(len(regexp_extract_all(html, '[A-Za-z0-9+/=]{{40,}}')) AS INTEGER) AS n_runs, {_ENTROPY} AS high_entropy
FROM v_pages""", ("v_pages",))
def q_base64_runs(spark, sf_dir):
    df = _v(spark, sf_dir, "v_pages")
    runs = F.regexp_extract_all(F.col("html"), F.lit(tx.BASE64_RUN_RE), 0)
    return df.select("n", F.size(runs).alias("n_runs"), tx.has_high_entropy_run(F.col("html")).alias("high_entropy"))


def _title_brand_sql(title_lower: str, reg: str) -> str:
    parts = [f"WHEN contains({title_lower}, {O.q(b.first_word)}) AND NOT {O.owned_sql(reg, R, b.ord)} "
             f"THEN {O.q(b.name)}" for b in R.brands if b.first_word]
    return "CASE " + " ".join(parts) + " END"


@query("title_mismatch", f"""
WITH reg AS ({O.registrable_cte(R, 'v_pages')}),
t AS (SELECT p.n, p.host, regexp_matches(p.html, '{_TITLE_RE}') AS title_found,
             regexp_extract(p.html, '{_TITLE_RE}', 1) AS title, reg.registrable
      FROM v_pages p JOIN reg ON reg.host = p.host)
SELECT n, host, title_found, title,
       CASE WHEN title_found THEN {_title_brand_sql('lower(title)', 'registrable')} END AS brand
FROM t""", ("v_pages",))
def q_title_mismatch(spark, sf_dir):
    df = with_registrable(_pages_features(spark, sf_dir), R)
    r = H.title_brand_mismatch(RuleContext(R, _as_of()))
    df = df.withColumn("primary", F.struct("f"))
    brand = F.coalesce(*[F.when(F.array_contains(F.col("f.title_brands"), F.lit(b.ord))
                                & ~owned_by_brand(F.col("registrable"), R, b.ord), F.lit(b.name)) for b in R.brands],
                       F.lit(None).cast("string"))
    return df.select("n", "host", F.col("f.title_found").alias("title_found"), F.col("f.title_text").alias("title"),
                     F.when(r["suspicious"], brand).alias("brand"))


@query("forbidden_tokens", f"""
WITH {_PF}, b AS (
  SELECT n, {O.contains_any_sql('lower(host)', R.content_tokens, False)} AS host_hit,
         {O.contains_any_sql('lo', R.content_tokens, False)} AS content_hit FROM pf)
SELECT n, host_hit, content_hit, host_hit OR content_hit AS forbidden_tokens FROM b""", ("v_pages",))
def q_forbidden_tokens(spark, sf_dir):
    from lurewatch.functions.hosts import contains_any
    df = _pages_features(spark, sf_dir).withColumn("primary", F.struct("f"))
    r = H.forbidden_tokens(RuleContext(R, _as_of()))
    return df.select("n", contains_any(F.lower("host"), R.content_tokens, normalise=False).alias("host_hit"),
                     F.col("f.content_token_hit").alias("content_hit"), r["suspicious"].alias("forbidden_tokens"))


@query("brand_density", f"""
WITH {_PF}, reg AS ({O.registrable_cte(R, 'v_pages')}),
b AS (SELECT pf.n, CAST(len(words) AS INTEGER) AS words_total,
             CAST(len(list_filter(words, lambda w: list_contains({O.arr(O.DENSITY_WORDS)}, w))) AS INTEGER)
               AS brand_words, reg.registrable
      FROM pf JOIN reg ON reg.host = pf.host)
SELECT n, words_total, brand_words,
  CASE WHEN words_total > 0 THEN round(brand_words / words_total, 6) END AS density,
  (NOT {O.owned_sql('registrable', R)}) AND words_total > 0
    AND brand_words / words_total > {R.thresholds.brand_density_threshold} AS brand_content_density
FROM b""", ("v_pages",))
def q_brand_density(spark, sf_dir):
    df = with_registrable(_pages_features(spark, sf_dir), R).withColumn("primary", F.struct("f"))
    r = H.brand_content_density(RuleContext(R, _as_of()))
    tot, cnt = F.col("f.words_total"), F.col("f.brand_words")
    return df.select("n", tot.alias("words_total"), cnt.alias("brand_words"),
                     F.when(tot > 0, F.round(cnt / tot, 6)).alias("density"),
                     r["suspicious"].alias("brand_content_density"))


@query("https_login", f"""
SELECT n, {_PASSWORD} AS password, starts_with(final_url, 'http://') AS plain_http,
       {_PASSWORD} AND starts_with(final_url, 'http://') AS https_login FROM v_pages""", ("v_pages",))
def q_https_login(spark, sf_dir):
    df = _pages_features(spark, sf_dir).withColumn("primary", F.struct("final_url", "f"))
    r = H.https_login(RuleContext(R, _as_of()))
    return df.select("n", F.col("f.password").alias("password"),
                     F.col("final_url").startswith("http://").alias("plain_http"), r["suspicious"].alias("https_login"))


# ---------------------------------------------------------------------------
# Capture roll-ups (D1-D17) over the capture views
# ---------------------------------------------------------------------------

def _caps(spark, sf_dir):
    from lurewatch.plans.fixtures import driver_captures
    return driver_captures(spark, sf_dir)


def _hist_sql(hops: str) -> str:
    return (f"array_to_string(list_transform(range(1, {hops} + 1), "
            "lambda k: CASE WHEN k % 2 = 1 THEN 301 ELSE 302 END), ',')")


@query("capture_pair", f"""
SELECT host,
  CAST(max(status) FILTER (WHERE variant = 'primary') AS INTEGER) AS p_status,
  CAST(max(status) FILTER (WHERE variant = 'alternative') AS INTEGER) AS a_status,
  max({_hist_sql('hops')}) FILTER (WHERE variant = 'primary') AS p_history,
  CAST(max(length(html)) FILTER (WHERE variant = 'alternative') AS INTEGER) AS a_len,
  max(CASE WHEN variant = 'robots' AND status = 200 AND coalesce(html, '') <> '' THEN html END) AS robots
FROM v_http GROUP BY host""", ("v_http",))
def q_capture_pair(spark, sf_dir):
    from lurewatch.operators.captures import capture_pair
    pair = capture_pair(_caps(spark, sf_dir).http)
    return pair.select("host", F.col("primary.status").alias("p_status"), F.col("alternative.status").alias("a_status"),
                       F.array_join(F.col("primary.history"), ",").alias("p_history"),
                       F.length(F.col("alternative.html")).alias("a_len"), "robots")


_DNS_OK = "rcode IN ('NOERROR', 'NODATA') AND rdata IS NOT NULL"


def _dns_list(cond: str) -> str:
    return f"string_agg(rdata, ',' ORDER BY pos, rdata) FILTER (WHERE {cond} AND {_DNS_OK})"


_DNS_AGG = f"""dagg AS (
  SELECT host,
    {_dns_list("qname = host AND rdtype = 'A'")} AS a,
    {_dns_list("qname = host AND rdtype = 'AAAA'")} AS aaaa,
    {_dns_list("qname = host AND rdtype = 'MX'")} AS mx,
    {_dns_list("qname = host AND rdtype = 'NS'")} AS ns,
    {_dns_list("qname = host AND rdtype = 'TXT' AND contains(lower(rdata), 'spf1')")} AS spf,
    {_dns_list("qname = '_dmarc.' || host AND rdtype = 'TXT' AND contains(rdata, 'DMARC1')")} AS dmarc,
    CAST(min(ttl) FILTER (WHERE qname = host AND rdtype IN ('A', 'AAAA') AND {_DNS_OK}) AS INTEGER) AS ttl,
    min(rcode || ': ' || qname) FILTER (WHERE rcode NOT IN ('NOERROR', 'NODATA')) AS err
  FROM v_dns GROUP BY host),
dsnap AS (
  SELECT host, CASE WHEN err IS NULL THEN coalesce(a, '') ELSE '' END AS a_records,
    CASE WHEN err IS NULL THEN coalesce(aaaa, '') ELSE '' END AS aaaa_records,
    CASE WHEN err IS NULL THEN coalesce(mx, '') ELSE '' END AS mx,
    CASE WHEN err IS NULL THEN coalesce(ns, '') ELSE '' END AS ns,
    CASE WHEN err IS NULL THEN coalesce(spf, '') ELSE '' END AS spf,
    CASE WHEN err IS NULL THEN coalesce(dmarc, '') ELSE '' END AS dmarc,
    CASE WHEN err IS NULL THEN ttl END AS ttl_min, err AS error
  FROM dagg)"""


@query("dns_rollup", f"WITH {_DNS_AGG} SELECT * FROM dsnap", ("v_dns",))
def q_dns_rollup(spark, sf_dir):
    from lurewatch.operators.captures import dns_snapshot
    snap = dns_snapshot(_caps(spark, sf_dir).dns_records)
    lists = ["a_records", "aaaa_records", "mx", "ns", "spf", "dmarc"]
    return snap.select("host", *[F.array_join(c, ",").alias(c) for c in lists], "ttl_min", "error")


_PTR = f"""{_DNS_AGG},
arows AS (SELECT d.host, d.pos, d.rdata FROM v_dns d JOIN dagg g ON g.host = d.host
          WHERE g.err IS NULL AND d.qname = d.host AND d.rdtype = 'A' AND d.rcode IN ('NOERROR', 'NODATA')
            AND d.rdata IS NOT NULL),
pt AS (SELECT a.host, p.target, min(a.pos) AS fp FROM arows a JOIN v_ptr p ON p.ip = a.rdata GROUP BY a.host, p.target),
pagg AS (SELECT host, string_agg(target, ',' ORDER BY fp, target) AS ptrs FROM pt GROUP BY host)"""


@query("ptr_rollup", f"""
WITH {_PTR}
SELECT s.host, CAST(CASE WHEN s.a_records = '' THEN 0 ELSE len(string_split(s.a_records, ',')) END AS INTEGER) AS n_a,
       coalesce(pagg.ptrs, '') AS ptrs
FROM dsnap s LEFT JOIN pagg ON pagg.host = s.host""", ("v_dns", "v_ptr"))
def q_ptr_rollup(spark, sf_dir):
    from lurewatch.operators.captures import dns_info
    c = _caps(spark, sf_dir)
    d = dns_info(c.dns_records, c.ptr_records)
    return d.select("host", F.size("dns.a_records").alias("n_a"), F.array_join("dns.ptr_records", ",").alias("ptrs"))


_CERT = """cf AS (
  SELECT host, error,
    CASE WHEN error IS NULL THEN [x FOR x IN CAST(json_extract(body, '$.subject') AS VARCHAR[][][])
                                 IF x[1][1] = 'commonName'][1][1][2] END AS cn,
    CASE WHEN error IS NULL THEN [x FOR x IN CAST(json_extract(body, '$.subject') AS VARCHAR[][][])
                                 IF x[1][1] = 'organizationName'][1][1][2] END AS org,
    CASE WHEN error IS NULL THEN array_to_string([x[2] FOR x IN CAST(json_extract(body, '$.subjectAltName')
                                 AS VARCHAR[][])], ',') ELSE '' END AS san,
    CASE WHEN error IS NULL THEN json_extract_string(body, '$.notBefore') END AS not_before
  FROM v_cert)"""


@query("cert_fields", f"WITH {_CERT} SELECT host, cn, org, san, not_before, error FROM cf", ("v_cert",))
def q_cert_fields(spark, sf_dir):
    from lurewatch.operators.captures import cert_fields
    c = cert_fields(_caps(spark, sf_dir).cert)
    return c.select("host", F.col("cert.cn").alias("cn"), F.col("cert.org").alias("org"),
                    F.array_join("cert.san", ",").alias("san"), F.col("cert.not_before").alias("not_before"),
                    F.col("cert.error").alias("error"))


_RDAP = """rd AS (
  SELECT host, e AS error, CASE WHEN e IS NULL THEN created END AS created,
         CASE WHEN e IS NULL THEN registrar END AS registrar
  FROM (
    SELECT host,
      CASE WHEN status <> 200 OR coalesce(body, '') = '' THEN 'http_status=' || CAST(status AS VARCHAR)
           WHEN NOT json_valid(body) THEN 'invalid json'
           WHEN json_type(body) <> 'OBJECT' THEN 'unexpected json' END AS e,
      CASE WHEN json_valid(body) THEN json_extract_string(
        [x FOR x IN coalesce(CAST(json_extract(body, '$.events') AS JSON[]), [])
         IF json_extract_string(x, '$.eventAction') = 'registration'][1], '$.eventDate') END AS created,
      CASE WHEN json_valid(body) THEN json_extract_string(
        [f FOR f IN coalesce(CAST(json_extract(
          [x FOR x IN coalesce(CAST(json_extract(body, '$.entities') AS JSON[]), [])
           IF list_contains(coalesce(CAST(json_extract(x, '$.roles') AS VARCHAR[]), []), 'registrar')][1],
          '$.vcardArray[1]') AS JSON[]), [])
         IF json_extract_string(f, '$[0]') = 'fn'][1], '$[3]') END AS registrar
    FROM v_rdap) t)"""


@query("rdap_fields", f"WITH {_RDAP} SELECT host, created, registrar, error FROM rd", ("v_rdap",))
def q_rdap_fields(spark, sf_dir):
    from lurewatch.operators.captures import rdap_fields
    r = rdap_fields(_caps(spark, sf_dir).rdap, key="host")
    return r.select("host", F.col("registration.created").alias("created"),
                    F.col("registration.registrar").alias("registrar"), F.col("registration.error").alias("error"))


_FAV = """fv AS (
  SELECT host, CASE WHEN status = 200 AND content <> '' THEN sha1(content) END AS sha1,
         CASE WHEN NOT (status = 200 AND content <> '') THEN 'http_status=' || CAST(status AS VARCHAR) END AS error
  FROM v_favicon)"""


@query("favicon_sha1", f"WITH {_FAV} SELECT host, sha1, error FROM fv", ("v_favicon",))
def q_favicon_sha1(spark, sf_dir):
    from lurewatch.operators.captures import favicon_fields
    f = favicon_fields(_caps(spark, sf_dir).favicon)
    return f.select("host", F.col("favicon.sha1").alias("sha1"), F.col("favicon.error").alias("error"))


_CNAME = """e AS (SELECT src, min(target) AS target FROM v_cname GROUP BY src),
walk AS (
  SELECT p.host, 0 AS hop, e.target FROM v_pages p JOIN e ON e.src = p.host
  UNION ALL
  SELECT w.host, w.hop + 1, e.target FROM walk w JOIN e ON e.src = rtrim(w.target, '.') WHERE w.hop < 9),
chains AS (
  SELECT p.host, coalesce(string_agg(w.target, ',' ORDER BY w.hop), '') AS chain,
         CAST(count(w.hop) AS INTEGER) AS hops,
         arg_min(w.target, w.hop) FILTER (WHERE contains(lower(w.target), 'm247')) AS _unused
  FROM v_pages p LEFT JOIN walk w ON w.host = p.host GROUP BY p.host)"""


@query("cname_chain", f"WITH RECURSIVE {_CNAME} SELECT host, chain, hops FROM chains", ("v_pages", "v_cname"))
def q_cname_chain(spark, sf_dir):
    ch = _cname_rollup(spark, sf_dir)
    return ch.select("host", F.array_join("cname.chain", ",").alias("chain"), F.size("cname.chain").alias("hops"))


def _hosting_hit_sql(target: str) -> str:
    return O.contains_any_sql(f"lower({target})", [h.lower() for h in R.hosting_substrings], False)


@query("bulletproof", f"""
WITH RECURSIVE {_CNAME},
hit AS (SELECT host, arg_min(target, hop) AS cname_target FROM walk WHERE {_hosting_hit_sql('target')} GROUP BY host)
SELECT c.host, hit.cname_target, hit.cname_target IS NOT NULL AS bulletproof_host
FROM chains c LEFT JOIN hit ON hit.host = c.host""", ("v_pages", "v_cname"))
def q_bulletproof(spark, sf_dir):
    from lurewatch.functions.hosts import first_hit
    ch = _cname_rollup(spark, sf_dir)
    r = H.bulletproof_host(RuleContext(R, _as_of()))
    return ch.select("host", first_hit(F.col("cname.chain"), R.hosting_substrings).alias("cname_target"),
                     r["suspicious"].alias("bulletproof_host"))


_CT = """ctq AS (
  SELECT host, e AS error,
    CASE WHEN e IS NULL AND json_type(body) = 'ARRAY' THEN CAST(json_array_length(body) AS INTEGER) ELSE 0 END
      AS cert_count,
    CASE WHEN e IS NULL AND json_type(body) = 'ARRAY' THEN list_min(list_filter(
      [coalesce(nullif(json_extract_string(c, '$.not_before'), ''), nullif(json_extract_string(c, '$.entry_timestamp'), ''))
       FOR c IN CAST(json_extract(body, '$[*]') AS JSON[])], lambda d: d IS NOT NULL)) END AS earliest_date
  FROM (SELECT host, CASE WHEN json_valid(body) THEN body END AS body,
          CASE WHEN status <> 200 OR coalesce(body, '') = '' THEN 'http_status=' || CAST(status AS VARCHAR)
               WHEN NOT json_valid(body) THEN 'invalid json' END AS e
        FROM v_ct) t)"""

_AS_OF_US = "epoch_us(TIMESTAMP '2026-01-15 12:00:00')"


def _age_sql(ts: str) -> str:
    return f"CAST(floor(({_AS_OF_US} - epoch_us({ts})) / 86400000000) AS INTEGER)"


_REG_AGE = f"""ra AS (
  SELECT host, CASE WHEN error IS NULL AND coalesce(created, '') <> '' THEN
    {_age_sql("try_cast(replace(trim(created), 'Z', '+00:00') AS TIMESTAMPTZ)")} END AS reg_age
  FROM rd)"""


@query("ct_history", f"""
WITH {_CT}, {_RDAP}, {_REG_AGE}
SELECT ctq.host, cert_count, earliest_date, error,
  (error IS NULL AND cert_count > 0 AND cert_count <= {R.thresholds.ct_few_certs}
   AND (cert_count = 1 OR coalesce(ra.reg_age < {R.thresholds.new_domain_days}, false))) AS ct_suspicious
FROM ctq JOIN ra ON ra.host = ctq.host""", ("v_ct", "v_rdap"))
def q_ct_history(spark, sf_dir):
    from lurewatch.operators.captures import ct_history, rdap_fields
    c = _caps(spark, sf_dir)
    j = ct_history(c.ct, key="host").join(rdap_fields(c.rdap, key="host"), "host")
    ctx = RuleContext(R, _as_of())
    j = j.withColumn("_reg_age", H._registration_age(ctx))
    r = H.ct_history(ctx)
    return j.select("host", F.col("ct.cert_count").alias("cert_count"), F.col("ct.earliest_date").alias("earliest_date"),
                    F.col("ct.error").alias("error"), r["suspicious"].alias("ct_suspicious"))


@query("favicon_mismatch", f"""
WITH {_FAV}, reg AS ({O.registrable_cte(R, 'v_favicon')})
SELECT fv.host, fv.sha1,
  coalesce(fv.sha1 IN ({', '.join(O.q(h) for h in R.favicon_hashes)}), false) AND NOT {O.owned_sql('reg.registrable', R)}
    AS favicon_brand_mismatch
FROM fv JOIN reg ON reg.host = fv.host""", ("v_favicon",))
def q_favicon_mismatch(spark, sf_dir):
    from lurewatch.operators.captures import favicon_fields
    f = with_registrable(favicon_fields(_caps(spark, sf_dir).favicon), R)
    r = H.favicon_brand_mismatch(RuleContext(R, _as_of()))
    return f.select("host", F.col("favicon.sha1").alias("sha1"), r["scam"].alias("favicon_brand_mismatch"))


@query("age_rules", f"""
WITH {_RDAP}, {_REG_AGE},
ca AS (SELECT host, CASE WHEN error IS NULL AND coalesce(nb, '') <> '' THEN
         {_age_sql("try_strptime(regexp_replace(trim(nb), '\\s+', ' ', 'g'), '%b %d %H:%M:%S %Y GMT')")} END AS cert_age
       FROM (SELECT host, error, json_extract_string(body, '$.notBefore') AS nb FROM v_cert) t)
SELECT ra.host, ra.reg_age AS reg_age_days, coalesce(ra.reg_age < {R.thresholds.new_domain_days}, false) AS domain_age,
       ca.cert_age AS cert_age_days, coalesce(ca.cert_age < {R.thresholds.cert_age_days}, false) AS cert_age
FROM ra JOIN ca ON ca.host = ra.host""", ("v_rdap", "v_cert"))
def q_age_rules(spark, sf_dir):
    from lurewatch.functions import dates as dt
    from lurewatch.operators.captures import cert_fields, rdap_fields
    c = _caps(spark, sf_dir)
    j = rdap_fields(c.rdap, key="host").join(cert_fields(c.cert), "host")
    ctx = RuleContext(R, _as_of())
    cert = F.col("cert")
    valid = _cvalid = cert.isNotNull() & (F.coalesce(cert["error"], F.lit("")) == "") & \
        (F.coalesce(cert["not_before"], F.lit("")) != "")
    cage = F.when(valid, dt.age_days(dt.parse_cert_date(cert["not_before"]), ctx.as_of))
    j = j.withColumn("_reg_age", H._registration_age(ctx))
    return j.select("host", F.col("_reg_age").alias("reg_age_days"), H.domain_age(ctx)["suspicious"].alias("domain_age"),
                    cage.alias("cert_age_days"), H.cert_age(ctx)["suspicious"].alias("cert_age"))


# ---------------------------------------------------------------------------
# Context-level rules, scoring and verdicts
# ---------------------------------------------------------------------------

def _cname_rollup(spark, sf_dir) -> DataFrame:
    """CNAME chains of every page host, materialised once (read by ``cname_chain`` and the context)."""
    from lurewatch.operators.captures import cname_chains

    def build():
        return cname_chains(_v(spark, sf_dir, "v_pages").select("host"), _caps(spark, sf_dir).cname_records)
    return _materialised(spark, sf_dir, "cname", build)


def _context(spark, sf_dir) -> DataFrame:
    """The host context (all capture roll-ups joined), materialised once per data directory."""
    from lurewatch.plans.triage import build_context

    def build():
        caps = _caps(spark, sf_dir)
        caps.rollups = {"cname": _cname_rollup(spark, sf_dir)}
        return build_context(_v(spark, sf_dir, "v_pages").select("host"), caps, R)
    return _materialised(spark, sf_dir, "context", build)


def _rules_frame(spark, sf_dir) -> DataFrame:
    from lurewatch.operators.verdict import evaluate_rules
    return evaluate_rules(_context(spark, sf_dir), R, _as_of())


def _rule(i: int) -> str:
    return f"__rule_{i:02d}"


def _tokens_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{O.WORD}+'))"


_PARKING_SERVERS = ("parking", "bodis", "sedo")
_FREEMAIL = ("google.com", "gmail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "yahoo.co",
             "protonmail.com", "icloud.com")

_CTX = f"""{_PTR}, {_CERT}, {_RDAP}, {_REG_AGE}, {_FAV}, {_CNAME}, {_CT},
reg AS ({O.registrable_cte(R, 'v_pages')}),
hp AS (SELECT host, status, html, lower(html) AS lo, final_url, server, hsts, csp, xfo, xcto, hops,
              regexp_extract_all(lower(html), '{O.WORD}+') AS words
       FROM v_http WHERE variant = 'primary'),
ha AS (SELECT host, html FROM v_http WHERE variant = 'alternative'),
hr AS (SELECT host, CASE WHEN status = 200 AND coalesce(html, '') <> '' THEN html END AS robots
       FROM v_http WHERE variant = 'robots'),
bp AS (SELECT host, arg_min(target, hop) AS hit FROM walk WHERE {_hosting_hit_sql('target')} GROUP BY host),
lk AS (
  SELECT n, min(dist) AS dist, arg_min(kind, [dist, b_ord, ci, pos]) AS lk_kind,
         arg_min(target, [dist, b_ord, ci, pos]) AS lk_target FROM (
    SELECT c.n, c.ci, lt.b_ord, lt.pos, lt.kind, lt.target,
      levenshtein(CASE WHEN lt.kind = 'name' THEN {O.skeleton_sql('c.cand')}
                       ELSE {O.skeleton_sql("split_part(c.cand, '.', 1)")} END, lt.skel) AS dist
    FROM (SELECT p.n, 0 AS ci, lower(p.host) AS cand FROM v_pages p
          UNION ALL
          SELECT p.n, 1 AS ci, lower(CASE WHEN reg.registrable <> '' THEN reg.registrable ELSE p.host END)
          FROM v_pages p JOIN reg ON reg.host = p.host) c
    CROSS JOIN {O.lookalike_targets_values(R)}) t
  WHERE dist <= {R.thresholds.lookalike_max_distance}
  GROUP BY n),
f0 AS (
  SELECT p.n, p.host, hp.status, hp.html, hp.lo, hp.final_url, hp.words, ha.html AS alt_html,
    fv.sha1, reg.registrable, reg.suffix,
    ds.a_records, ds.aaaa_records, ds.mx, ds.ns, ds.spf, ds.dmarc, ds.ttl_min, ds.error AS dns_err,
    CASE WHEN ds.a_records = '' THEN 0 ELSE len(string_split(ds.a_records, ',')) END AS n_a,
    coalesce(pagg.ptrs, '') AS ptrs,
    hp.server, hp.hsts, hp.csp, hp.xfo, hp.xcto, hp.hops, hr.robots,
    cf.cn, cf.org, cf.error AS cert_err, cf.not_before, ra.reg_age, ctq.cert_count, ctq.error AS ct_err,
    bp.hit AS bp_hit, lk.dist AS lk_dist, lk.lk_kind, lk.lk_target
  FROM v_pages p JOIN hp ON hp.host = p.host JOIN ha ON ha.host = p.host JOIN hr ON hr.host = p.host
  JOIN fv ON fv.host = p.host JOIN reg ON reg.host = p.host JOIN dsnap ds ON ds.host = p.host
  LEFT JOIN pagg ON pagg.host = p.host JOIN cf ON cf.host = p.host JOIN ra ON ra.host = p.host
  JOIN ctq ON ctq.host = p.host LEFT JOIN bp ON bp.host = p.host LEFT JOIN lk ON lk.n = p.n),
f AS (
  SELECT *, {_PASSWORD} AS pw, {_OTP} AS otp, {_CARD} AS cc, {_XPOST} AS xpost, {_EXFIL} AS exfil,
    {_JS} AS js, {_ENTROPY} AS ent, {_WALLET} AS wallet, {_CLIP} AS clip, {_KIT} AS kit,
    {O.contains_any_sql('lower(final_url)', R.kit_paths, False)} AS path_hit,
    {O.owned_sql('registrable', R)} AS owned
  FROM f0),
g AS (
  SELECT *, {_tokens_sql('html')} AS ta, {_tokens_sql('alt_html')} AS tb,
    CASE WHEN {O.contains_any_sql('lower(host)', R.trusted_l, False)} THEN 'dropped'
         WHEN {O.contains_any_sql('lower(host)', R.auto_scam_l, False)} THEN 'scam' END AS gate,
    CASE WHEN title_found THEN {_title_brand_sql('lower(title)', 'registrable')} END AS title_brand,
    {_age_sql("try_strptime(regexp_replace(trim(not_before), '\\s+', ' ', 'g'), '%b %d %H:%M:%S %Y GMT')")} AS cert_age
  FROM (SELECT *, regexp_matches(html, '{_TITLE_RE}') AS title_found,
               regexp_extract(html, '{_TITLE_RE}', 1) AS title FROM f) t),
r AS (
  SELECT n, host, gate,
    (pw OR cc) AND (exfil OR xpost) AS s01,
    kit AS s02,
    coalesce(sha1 IN ({', '.join(O.q(h) for h in R.favicon_hashes)}), false) AND NOT owned AS s03,
    NOT (status >= 200 AND status < 300) OR (a_records = '' AND aaaa_records = '' AND mx = '' AND ns = '') AS b04,
    {O.contains_any_sql('lo', R.parking_signatures, False)}
      OR {O.contains_any_sql("lower(coalesce(server, ''))", _PARKING_SERVERS, False)} AS b05,
    (cert_err IS NULL AND coalesce(org, '') <> '') OR hsts IS NOT NULL AS b06,
    pw OR otp OR cc OR js OR ent OR wallet OR clip AS u01,
    path_hit AS u02,
    coalesce(lk_dist <= {R.thresholds.lookalike_max_distance}, false) AS u07,
    coalesce(reg_age < {R.thresholds.new_domain_days}, false) AS u08,
    starts_with(host, 'xn--') OR contains(host, '.xn--') OR contains(host, 'ı') AS u09,
    {O.contains_any_sql('lower(host)', R.content_tokens, False)} OR {O.contains_any_sql('lo', R.content_tokens, False)} AS u10,
    hops >= {R.thresholds.redirect_min_hops} OR (
      (CASE WHEN html = '' AND alt_html = '' THEN 0.0 WHEN html = '' OR alt_html = '' THEN 1.0
            WHEN len(ta) = 0 AND len(tb) = 0 THEN 0.0
            ELSE 1.0 - len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END)
        > {R.thresholds.cloaking_diff_ratio}
      AND (length(html) > {R.thresholds.cloaking_min_content_len} OR length(alt_html) > {R.thresholds.cloaking_min_content_len})) AS u11,
    cert_err IS NULL AND coalesce(cert_age < {R.thresholds.cert_age_days}, false) AS u12,
    NOT owned AND len(words) > 0 AND
      len(list_filter(words, lambda w: list_contains({O.arr(O.DENSITY_WORDS)}, w))) / len(words)
        > {R.thresholds.brand_density_threshold} AS u13,
    pw AND starts_with(final_url, 'http://') AS u14,
    coalesce(lower(suffix) IN ({', '.join(O.q(t) for t in R.suspicious_tlds)}), false) AS u15,
    title_brand IS NOT NULL AS u16,
    bp_hit IS NOT NULL AS u17,
    ct_err IS NULL AND cert_count > 0 AND cert_count <= {R.thresholds.ct_few_certs}
      AND (cert_count = 1 OR coalesce(reg_age < {R.thresholds.new_domain_days}, false)) AS u18,
    dns_err IS NULL AND (n_a >= {R.thresholds.fast_flux_min_a} OR coalesce(ttl_min < {R.thresholds.fast_flux_max_ttl}, false)
      OR (mx <> '' AND (contains(lower(spf), '+all') OR contains(lower(spf), '~all') OR dmarc = ''
                        OR contains(lower(dmarc), 'p=none')))) AS u19,
    cert_err IS NULL AND coalesce(cn, '') <> '' AND
      ({' OR '.join(f"contains(lower(cn), {O.q(b.name.lower())})" for b in R.brands)}) AND NOT owned AS u20,
    len(list_filter(string_split(host, '.'), lambda x: x <> '')) >= {R.thresholds.subdomain_min_depth} AS u21,
    status = 200 AND csp IS NULL AND xfo IS NULL AND xcto IS NULL AS u22,
    dns_err IS NULL AND len(list_filter(string_split(mx, ','), lambda m: m <> '' AND
      {O.contains_any_sql("rtrim(lower(m), '.')", _FREEMAIL, False)})) > 0 AS u23,
    dns_err IS NULL AND n_a > 0 AND ptrs = '' AS u24,
    status = 200 AND n_a > 0 AND robots IS NULL AS u25
  FROM g)"""

def _flags():
    from lurewatch.rules import RULE_ORDER
    out = []
    for i, (name, w) in enumerate(RULE_ORDER, 1):
        s = f"s{i:02d}" if i in (1, 2, 3) else None
        b = f"b{i:02d}" if i in (4, 5, 6) else None
        u = f"u{i:02d}" if i not in (3, 4, 5, 6) else None
        out.append((i, name, w, s, b, u))
    return out


def _susp_sql(i, s, b, u):
    """Suspicious only when the rule is not definitive."""
    if u is None:
        return "false"
    cond = f"coalesce({u}, false)"
    if s:
        cond += f" AND NOT coalesce({s}, false)"
    if b:
        cond += f" AND NOT coalesce({b}, false)"
    return cond


def _verdict_sql() -> str:
    fl = _flags()
    tally = " + ".join(f"CASE WHEN {_susp_sql(i, s, b, u)} THEN {w} ELSE 0 END" for i, _, w, s, b, u in fl)
    total = sum(w for _, _, w, _, _, _ in fl)
    first = " ".join(
        f"WHEN coalesce({s or b}, false) THEN {O.q(name)}" for i, name, w, s, b, u in fl if s or b)
    first_scam = " ".join(
        f"WHEN coalesce({s or b}, false) THEN {'true' if s else 'false'}" for i, name, w, s, b, u in fl if s or b)
    return f"""v AS (
  SELECT n, host, gate, CAST({tally} AS INTEGER) AS tally, CASE {first} END AS first_rule,
         CASE {first_scam} END AS first_scam FROM r),
sv AS (
  SELECT host, tally, tally / {total} AS score,
    CASE WHEN gate IS NULL THEN first_rule END AS decided_by,
    CASE WHEN gate = 'dropped' THEN NULL WHEN gate = 'scam' THEN 'scam'
         WHEN first_rule IS NOT NULL THEN CASE WHEN first_scam THEN 'scam' ELSE 'benign' END
         WHEN tally / {total} >= {R.thresholds.scam} THEN 'scam' ELSE 'inconclusive' END AS verdict
  FROM v)"""


_ALL_VIEWS = ("v_pages", "v_http", "v_dns", "v_ptr", "v_cert", "v_rdap", "v_favicon", "v_cname", "v_ct")


@query("benign_rules", f"""
WITH RECURSIVE {_CTX}
SELECT host, coalesce(b04, false) AS inactive_domain, coalesce(b05, false) AS parking_detect,
       coalesce(b06, false) AS long_lived_or_verified FROM r""", _ALL_VIEWS)
def q_benign_rules(spark, sf_dir):
    df = _rules_frame(spark, sf_dir)
    return df.select("host", F.col(_rule(4))["benign"].alias("inactive_domain"),
                     F.col(_rule(5))["benign"].alias("parking_detect"),
                     F.col(_rule(6))["benign"].alias("long_lived_or_verified"))


@query("cloaking", f"""
WITH RECURSIVE {_CTX}
SELECT host, CAST(hops AS INTEGER) AS hops, coalesce(u11, false) AS redirect_and_cloaking FROM r JOIN
  (SELECT host AS h2, hops FROM g) x ON x.h2 = r.host""", _ALL_VIEWS)
def q_cloaking(spark, sf_dir):
    df = _rules_frame(spark, sf_dir)
    return df.select("host", F.size("primary.history").alias("hops"),
                     F.col(_rule(11))["suspicious"].alias("redirect_and_cloaking"))


@query("dns_posture", f"""
WITH RECURSIVE {_CTX}
SELECT host, coalesce(u19, false) AS dns_email_posture, coalesce(u23, false) AS freemail_mx,
       coalesce(u24, false) AS reverse_dns_mismatch FROM r""", _ALL_VIEWS)
def q_dns_posture(spark, sf_dir):
    df = _rules_frame(spark, sf_dir)
    return df.select("host", F.col(_rule(19))["suspicious"].alias("dns_email_posture"),
                     F.col(_rule(23))["suspicious"].alias("freemail_mx"),
                     F.col(_rule(24))["suspicious"].alias("reverse_dns_mismatch"))


@query("tls_cn_brand", f"""
WITH RECURSIVE {_CTX}
SELECT r.host, g.cn, coalesce(u20, false) AS tls_cert FROM r JOIN g ON g.host = r.host""", _ALL_VIEWS)
def q_tls_cn_brand(spark, sf_dir):
    df = _rules_frame(spark, sf_dir)
    return df.select("host", F.col("cert.cn").alias("cn"), F.col(_rule(20))["suspicious"].alias("tls_cert"))


@query("header_rules", f"""
WITH RECURSIVE {_CTX}
SELECT host, coalesce(u22, false) AS missing_security_headers, coalesce(u25, false) AS no_robots_txt FROM r""",
       _ALL_VIEWS)
def q_header_rules(spark, sf_dir):
    df = _rules_frame(spark, sf_dir)
    return df.select("host", F.col(_rule(22))["suspicious"].alias("missing_security_headers"),
                     F.col(_rule(25))["suspicious"].alias("no_robots_txt"))


@query("jaccard_diff", f"""
WITH RECURSIVE {_CTX}
SELECT host, CAST(len(ta) AS INTEGER) AS n_primary, CAST(len(tb) AS INTEGER) AS n_alternative,
  CAST(len(list_intersect(ta, tb)) AS INTEGER) AS n_common,
  round(CASE WHEN html = '' AND alt_html = '' THEN 0.0 WHEN html = '' OR alt_html = '' THEN 1.0
        WHEN len(ta) = 0 AND len(tb) = 0 THEN 0.0
        ELSE 1.0 - len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END, 6) AS diff_ratio
FROM g""", _ALL_VIEWS)
def q_jaccard_diff(spark, sf_dir):
    pair = _context(spark, sf_dir)
    ps, as_ = F.col("primary.f.token_set"), F.col("alternative.f.token_set")
    return pair.select("host", F.size(ps).alias("n_primary"), F.size(as_).alias("n_alternative"),
                       F.size(F.array_intersect(ps, as_)).alias("n_common"),
                       F.round(H.diff_ratio_of_pair(), 6).alias("diff_ratio"))


@query("score_and_verdict", f"""
WITH RECURSIVE {_CTX}, {_verdict_sql()}
SELECT host, tally, score, decided_by, verdict FROM sv""", _ALL_VIEWS)
def q_score_and_verdict(spark, sf_dir):
    from lurewatch.operators.verdict import classify
    out = classify(_context(spark, sf_dir), R, _as_of())
    return out.select("host", "tally", "score", "decided_by", "verdict")


def _long_sql() -> str:
    parts = []
    for i, name, w, s, b, u in _flags():
        outcome = []
        if s:
            outcome.append(f"WHEN coalesce({s}, false) THEN 'scam'")
        if b:
            outcome.append(f"WHEN coalesce({b}, false) THEN 'benign'")
        if u:
            outcome.append(f"WHEN {_susp_sql(i, s, b, u)} THEN 'suspicious'")
        parts.append(f"SELECT host, {O.q(name)} AS name, {w} AS weight, CASE {' '.join(outcome)} END AS outcome FROM r")
    return " UNION ALL ".join(parts)


@query("rule_results_long", f"""
WITH RECURSIVE {_CTX}, lf AS ({_long_sql()})
SELECT host, name, weight, outcome FROM lf WHERE outcome IS NOT NULL""", _ALL_VIEWS)
def q_rule_results_long(spark, sf_dir):
    from lurewatch.operators.verdict import explain_long
    return explain_long(_context(spark, sf_dir), R, _as_of()).select("host", "name", "weight", "outcome")


@query("verdict_counts", f"""
WITH RECURSIVE {_CTX}, {_verdict_sql()}
SELECT vv.verdict, CAST(count(sv.host) AS BIGINT) AS n
FROM (VALUES ('scam'), ('inconclusive'), ('benign'), ('irrelevant')) vv(verdict)
LEFT JOIN sv ON sv.verdict = vv.verdict GROUP BY vv.verdict""", _ALL_VIEWS)
def q_verdict_counts(spark, sf_dir):
    from lurewatch.operators.verdict import classify, verdict_counts
    return verdict_counts(classify(_context(spark, sf_dir), R, _as_of()))


# ---------------------------------------------------------------------------
# Sources (A7-A11), dedup, sinks, streaming, Python rule
# ---------------------------------------------------------------------------

_CYCLE = "n % 3"
_PRIO = "CASE WHEN n % 3 = 2 AND n % 10 <> 9 THEN 1 WHEN n % 3 = 2 THEN 0 ELSE n % 2 END"
_COMMENT = "(coalesce(line, '') = '' OR starts_with(line, '#'))"


@query("feed_fallback", f"""
SELECT DISTINCT cycle, host FROM (
  SELECT cycle, line, prio, {O.norm_sql('line')} AS host,
         min(CASE WHEN coalesce(line, '') <> '' THEN prio END) OVER (PARTITION BY cycle) AS best
  FROM (SELECT n, line, CAST({_CYCLE} AS INTEGER) AS cycle, CAST({_PRIO} AS INTEGER) AS prio FROM v_raw) l) t
WHERE prio = best AND NOT {_COMMENT} AND host <> ''""", ("v_raw",))
def q_feed_fallback(spark, sf_dir):
    from lurewatch.sources.feeds import fallback_lines
    raw = _v(spark, sf_dir, "v_raw").select(
        "line", F.expr(_CYCLE).cast("int").alias("cycle"), F.expr(_PRIO).cast("int").alias("prio"))
    chosen = fallback_lines(raw, ["cycle"])
    line = F.col("line")
    keep = ~((F.coalesce(line, F.lit("")) == "") | line.startswith("#"))
    return (chosen.where(keep).select("cycle", normalize_host(line).alias("host"))
                  .where(F.col("host") != "").dropDuplicates(["cycle", "host"]))


def _json_bodies(spark, sf_dir) -> DataFrame:
    pages = _v(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), "url")
    item = F.to_json(F.struct(F.when(F.col("n") % 2 == 0, F.col("url")).otherwise(F.upper("url")).alias("url")))
    body = (F.when(F.col("n") % 7 == 0, F.lit("not json"))
             .when(F.col("n") % 11 == 0, item)
             .otherwise(F.concat(F.lit("["), item, F.lit(',{"no_url":true},{"url":null},{"url":""}]'))))
    return pages.select("n", body.alias("body"))


@query("feed_json", f"""
SELECT DISTINCT 'phishtank' AS source, host FROM (
  SELECT {O.norm_sql("CASE WHEN page_id % 2 = 0 THEN url ELSE upper(url) END")} AS host FROM pages
  WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND coalesce(url, '') <> '') t
WHERE host <> ''""")
def q_feed_json(spark, sf_dir):
    from lurewatch.sources.feeds import json_feed_hosts
    register_views(spark, sf_dir)
    return json_feed_hosts(_json_bodies(spark, sf_dir), source="phishtank")


_CC = "CASE n % 4 WHEN 0 THEN 'sg' WHEN 1 THEN 'MY' WHEN 2 THEN 'JP' ELSE 'XX' END"
_CODES = ("SG", "MY", "JP")


@query("feed_csv", f"""
SELECT DISTINCT 'urlhaus_country:' || upper(cc) AS source, host FROM (
  SELECT n, {_CC} AS cc, {O.norm_sql('line')} AS host FROM v_raw) t
WHERE n % 6 <> 0 AND n % 7 <> 0 AND upper(cc) IN ({', '.join(O.q(c) for c in _CODES)}) AND host <> ''""",
       ("v_raw",))
def q_feed_csv(spark, sf_dir):
    from lurewatch.sources.feeds import csv_feed_hosts, parse_csv_lines, select_sources
    raw = _v(spark, sf_dir, "v_raw").withColumn("cc", F.expr(_CC))
    first = F.when(F.col("n") % 6 == 0, F.lit("# comment")).otherwise(F.lit("2026-01-01 00:00:00"))
    rec = F.concat(F.lit('"'), first, F.lit('","http://x/","online","malware_download","'),
                   F.coalesce(F.col("line"), F.lit("")), F.lit('","1.2.3.4","AS1","'), F.col("cc"), F.lit('"'))
    short = F.concat(F.lit("only,four,fields,"), F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), ",", " "))
    lines = raw.select(F.when(F.col("n") % 7 == 0, short).otherwise(rec).alias("line"), F.upper("cc").alias("cc"))
    rows = select_sources(parse_csv_lines(lines), _CODES, col="cc")
    return csv_feed_hosts(rows, country_col="cc")


def _ct_messages(spark, sf_dir) -> DataFrame:
    raw = _v(spark, sf_dir, "v_raw")
    quoted = F.regexp_replace(F.regexp_replace(F.to_json(F.array(F.col("line"))), "^\\[", ""), "\\]$", "")
    quoted_up = F.regexp_replace(F.regexp_replace(F.to_json(F.array(F.upper("line"))), "^\\[", ""), "\\]$", "")
    update = F.concat(F.lit('{"message_type":"certificate_update","data":{"leaf_cert":{"all_domains":['),
                      quoted, F.lit(",123,null,"), quoted_up, F.lit(",{\"x\":1}]}}}"))
    value = (F.when(F.col("n") % 6 == 0, F.lit('{"message_type":"heartbeat"}'))
              .when(F.col("n") % 6 == 1, F.lit("null"))
              .when(F.col("n") % 6 == 2, F.lit('"plain string"'))
              .when(F.col("n") % 6 == 5, F.lit('{"message_type":"certificate_update","data":"x"}'))
              .otherwise(update))
    return raw.select("n", value.alias("value"))


@query("ct_domains", f"""
SELECT n, host FROM (
  SELECT n, {O.norm_sql('line')} AS host FROM v_raw WHERE n % 6 IN (3, 4) AND line IS NOT NULL
  UNION ALL
  SELECT n, {O.norm_sql('upper(line)')} AS host FROM v_raw WHERE n % 6 IN (3, 4) AND line IS NOT NULL) t
WHERE host <> ''""", ("v_raw",))
def q_ct_domains(spark, sf_dir):
    from lurewatch.sources.feeds import ct_hosts
    return ct_hosts(_ct_messages(spark, sf_dir)).select("n", "host")


@query("dedup_first_seen", f"""
SELECT host, n, ts FROM (
  SELECT host, n, ts, row_number() OVER (PARTITION BY host ORDER BY ts, n) AS rn FROM (
    SELECT r.n, e.ts, {O.norm_sql('r.line')} AS host FROM v_raw r JOIN events e ON e.event_id = r.n) a
  WHERE host <> '') b
WHERE rn = 1""", ("v_raw",))
def q_dedup_first_seen(spark, sf_dir):
    from lurewatch.plans.triage import dedup_hosts
    raw = _v(spark, sf_dir, "v_raw")
    ev = spark.table("events").select(F.col("event_id").alias("n"), "ts")
    arrivals = (raw.join(ev, "n").select(normalize_host(F.col("line")).alias("host"), "n", "ts")
                   .where(F.col("host") != ""))
    return dedup_hosts(arrivals, order_cols=["ts", "n"]).select("host", "n", "ts")


def _expected_triage_sql(src: str, host_expr: str) -> str:
    """Verdicts of hosts that have no capture rows: irrelevant / scam (auto) / pending; trusted dropped."""
    h = "h"
    return f"""
SELECT host, brand, verdict FROM (
  SELECT h AS host, {O.brand_sql(h, R)} AS brand,
    CASE WHEN {O.brand_sql(h, R)} IS NULL THEN 'irrelevant'
         WHEN {O.contains_any_sql(f'lower({h})', R.trusted_l, False)} THEN NULL
         WHEN {O.contains_any_sql(f'lower({h})', R.auto_scam_l, False)} THEN 'scam'
         ELSE 'pending' END AS verdict
  FROM (SELECT DISTINCT {host_expr} AS h FROM {src}) d WHERE h <> '') t
WHERE verdict IS NOT NULL"""


def _scratch(spark, tag: str) -> str:
    import uuid
    from lurewatch.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@query("sink_roundtrip", _expected_triage_sql("v_hosts", O.norm_sql("host")), ("v_hosts",))
def q_sink_roundtrip(spark, sf_dir):
    from lurewatch.plans.triage import Captures, triage
    from lurewatch.sources.sinks import read_verdicts, write_verdicts
    raw = _v(spark, sf_dir, "v_hosts").select(F.col("host").alias("line"), F.lit("manual").alias("source"))
    verdicts = triage(raw, Captures(), R, _as_of())
    root = _scratch(spark, "sink")
    write_verdicts(verdicts, root, fmt="text")
    return read_verdicts(spark, root, fmt="text")


_STREAM_SRC = f"""(SELECT line FROM v_raw WHERE n % 4 < 2
  UNION ALL SELECT line FROM v_raw WHERE n % 4 >= 2 AND NOT {_COMMENT}) s"""


@query("stream_triage", _expected_triage_sql(_STREAM_SRC, O.norm_sql("line")), ("v_raw",))
def q_stream_triage(spark, sf_dir):
    """Two landing sources (manual: no comment rule; urlhaus: '#' lines skipped) unioned, deduped in state."""
    from lurewatch.plans.triage import Captures
    from lurewatch.streaming.triage import start_triage, stream_hosts
    root = _scratch(spark, "stream")
    raw = _v(spark, sf_dir, "v_raw").select("n", F.coalesce(F.col("line"), F.lit("")).alias("value"))
    raw.where(F.col("n") % 4 < 2).select("value").repartition(2).write.text(f"{root}/landing/manual")
    raw.where(F.col("n") % 4 >= 2).select("value").repartition(2).write.text(f"{root}/landing/urlhaus")
    hosts = stream_hosts(spark, f"{root}/landing", [("manual", False), ("urlhaus", True)])
    q = start_triage(spark, hosts, lambda: Captures(), R, _as_of(), f"{root}/sink", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/sink").select("host", "brand", "verdict")


_TEXT_FEEDS = ("openphish", "urlhaus", "certpolska", "phishingdatabase", "phishingarmy", "botvrij", "manual")
_NO_RULE = ("openphish", "manual")


def _land_sources(spark, sf_dir, root: str) -> None:
    """Landing folders of all eleven sources, from the raw lines."""
    raw = _v(spark, sf_dir, "v_raw").select("n", F.coalesce("line", F.lit("")).alias("line"))
    for k, name in enumerate(_TEXT_FEEDS):
        raw.where(F.col("n") % len(_TEXT_FEEDS) == k).select(F.col("line").alias("value")).write.text(f"{root}/{name}")
    # the primary is empty, the mirror has the lines
    raw.limit(0).select(F.col("line").alias("value")).write.text(f"{root}/digitalside/prio=0")
    raw.select(F.col("line").alias("value")).write.text(f"{root}/digitalside/prio=1")
    quoted = F.regexp_replace(F.regexp_replace(F.to_json(F.array("line")), "^\\[", ""), "\\]$", "")
    raw.select(F.concat(F.lit('[{"url":'), quoted, F.lit("},{}]")).alias("value")).repartition(4).select("value").write.option("lineSep", "\n").text(f"{root}/lines")
    # one list per file, of a thousand lines at most
    lists = raw.groupBy(F.floor(F.col("n") / 1000).alias("block")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.concat(F.lit('{"url":'), quoted, F.lit("}"))), ","), F.lit("]")).alias("value"))
    lists.write.partitionBy("block").text(f"{root}/phishtank")
    cell = F.concat(F.lit('"'), F.replace("line", F.lit('"'), F.lit('""')), F.lit('"'))
    raw.select(F.concat(F.lit('"2026","http://x/""q""","online","m",'), cell, F.lit(',"1.2.3.4","AS1","SG"')).alias("value")).write.text(f"{root}/urlhaus_country/cc=SG")
    raw.select(F.concat(F.lit('{"message_type":"certificate_update","data":{"leaf_cert":{"all_domains":['), quoted, F.lit("]}}}")).alias("value")).write.text(f"{root}/certstream")


_ALL_SOURCES = _TEXT_FEEDS + ("digitalside", "phishtank", "urlhaus_country", "certstream")
_SOURCES_SQL = " UNION ALL ".join(
    [f"SELECT {O.q(name)} AS source, coalesce(line, '') AS line, {'false' if name in _NO_RULE else 'true'} AS rule FROM v_raw WHERE n % {len(_TEXT_FEEDS)} = {k}" for k, name in enumerate(_TEXT_FEEDS)]
    + ["SELECT 'digitalside', coalesce(line, ''), true FROM v_raw"]
    + [f"SELECT {O.q(name)}, coalesce(line, ''), false FROM v_raw" for name in ("phishtank", "urlhaus_country:SG", "certstream")])


@query("all_sources", f"""
SELECT DISTINCT source, host FROM (
  SELECT source, {O.norm_sql('line')} AS host FROM ({_SOURCES_SQL}) s
  WHERE NOT (rule AND (line = '' OR starts_with(line, '#')))) t
WHERE host <> ''""", ("v_raw",))
def q_all_sources(spark, sf_dir):
    """Every registered source, read from its landing folder."""
    from lurewatch.sources.feeds import read_sources
    root = _scratch(spark, "landing")
    _land_sources(spark, sf_dir, root)
    return read_sources(spark, root, _ALL_SOURCES).distinct()


#: Page hosts name none of the rules' brands; two more watched ones let most of them through to the captures.
_WATCHED = R.with_(brands=(*R.brands, Brand(3, "Example", (), ("example.com", "example.org"), ("blog.",)), Brand(4, "Net", (), ("example.net",), ())))

@query("stream_all_sources", f"""
SELECT DISTINCT source, host FROM (
  SELECT source, {O.norm_sql('line')} AS host FROM ({_SOURCES_SQL}) s
  WHERE NOT (rule AND (line = '' OR starts_with(line, '#')))) t
WHERE host <> ''""", ("v_raw",))
def q_stream_all_sources(spark, sf_dir):
    """Every source as a stream, polled by interval into the shared landing log, the mirror chosen per cycle."""
    from lurewatch.streaming.cadence import LOG_SCHEMA, start_groups
    root = _scratch(spark, "poll")
    _land_sources(spark, sf_dir, f"{root}/landing")
    for polls in start_groups(spark, f"{root}/landing", f"{root}/log", f"{root}/checkpoint", _ALL_SOURCES, once=True).values():
        polls.awaitTermination()
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/log").select("source", "host").distinct()


_DATE = "'20' || CAST(10 + n % 16 AS VARCHAR) || '-0' || CAST(1 + n % 9 AS VARCHAR) || '-01'"


@query("ct_history_stream", f"""
WITH reg AS ({O.registrable_cte(R, 'v_hosts')})
SELECT reg.registrable, count(*) AS cert_count, min({_DATE}) AS earliest_date
FROM v_hosts v JOIN reg ON reg.host = v.host WHERE reg.registrable <> '' GROUP BY reg.registrable""", ("v_hosts",))
def q_ct_history_stream(spark, sf_dir):
    """Certificate messages of every host, merged batch by batch into the history of its registrable."""
    from lurewatch.operators.certificates import history_table, start_history
    root = _scratch(spark, "ct-stream")
    hosts = _v(spark, sf_dir, "v_hosts").select("n", "host", F.expr(_DATE.replace("VARCHAR", "STRING")).alias("d"))
    leaf = F.struct(F.array("host", F.upper("host")).alias("all_domains"), F.col("d").alias("not_before"))
    message = F.to_json(F.struct(F.lit("certificate_update").alias("message_type"), F.struct(leaf.alias("leaf_cert")).alias("data")))
    hosts.repartition(3, "n").select(message.alias("value")).write.text(f"{root}/landing")
    start_history(spark, f"{root}/landing", f"{root}/history", f"{root}/checkpoint", R, files=1).awaitTermination()
    return history_table(spark, f"{root}/history").read()


@query("rule_errors", f"""
WITH RECURSIVE {_CTX}, {_verdict_sql()}
SELECT DISTINCT host, CASE WHEN host LIKE 'p1%' THEN 'failed' ELSE verdict END AS verdict,
       CASE WHEN host LIKE 'p1%' THEN 2 END AS attempts
FROM (SELECT sv.host, {O.brand_sql('sv.host', _WATCHED)} AS brand, sv.verdict FROM sv) t
WHERE brand IS NOT NULL AND verdict IS NOT NULL AND NOT {O.contains_any_sql('lower(host)', R.auto_scam_l, False)}""", _ALL_VIEWS)
def q_rule_errors(spark, sf_dir):
    """A rule raises on some hosts; their batches commit, they are tried once more and stay in the error table."""
    from lurewatch.operators.heuristics import DEFAULT_REGISTRY
    from lurewatch.operators.match import gate, relevant
    from lurewatch.operators.python_rules import guarded_rule
    from lurewatch.streaming.triage import error_table, start_triage, stream_hosts
    root = _scratch(spark, "rule-errors")

    def judge(host):
        if host.startswith("p1"):
            raise ValueError("no answer")
        return False, None

    registry = (*DEFAULT_REGISTRY, guarded_rule("remote_check", 0, judge))
    hosts = _v(spark, sf_dir, "v_pages").select("host").distinct()
    todo = relevant(hosts, _WATCHED).where(gate(F.col("host"), R).isNull())
    for run in range(3):  # hosts, then two batches of one host each that try the failed ones again
        lines = todo if run == 0 else spark.createDataFrame([(f"again{run}.example",)], "host string")
        lines.select(F.col("host").alias("value")).write.mode("append").text(f"{root}/landing/manual")
        stream = stream_hosts(spark, f"{root}/landing", [("manual", False)])
        start_triage(spark, stream, lambda: _caps(spark, sf_dir), R, _as_of(), f"{root}/sink", f"{root}/checkpoint", registry=registry, watched=_WATCHED).awaitTermination()
    done = spark.read.schema("host string, verdict string, brand string").parquet(f"{root}/sink").where(F.col("brand").isNotNull()).select("host", "verdict", F.lit(None).cast("int").alias("attempts"))
    return done.unionByName(error_table(spark, f"{root}/sink").read().select("host", F.lit("failed").alias("verdict"), "attempts"))


@query("python_rule", """
SELECT n, host, coalesce(list_aggregate(string_split(split_part(host, '.', 1), ''), 'entropy') >= 3.0, false) AS host_entropy
FROM v_hosts""", ("v_hosts",))
def q_python_rule(spark, sf_dir):
    """A registered Python rule over the reduced context."""
    from lurewatch.operators.python_rules import host_entropy_rule
    from lurewatch.operators.verdict import evaluate_rules
    hosts = _v(spark, sf_dir, "v_hosts").select("n", "host")
    return evaluate_rules(hosts, R, _as_of(), (host_entropy_rule(3.0),)).select("n", "host", F.col("__rule_01.suspicious").alias("host_entropy"))


_WHOLE_PATH = f"""
WITH RECURSIVE {_CTX}, {_verdict_sql()}
SELECT DISTINCT host, brand, CASE WHEN brand IS NULL THEN 'irrelevant' ELSE verdict END AS verdict
FROM (SELECT sv.host, {O.brand_sql('sv.host', _WATCHED)} AS brand, sv.verdict FROM sv) t
WHERE brand IS NULL OR verdict IS NOT NULL"""


def _page_lines(spark, sf_dir) -> DataFrame:
    """Every page host twice, as two sources would name it."""
    hosts = _v(spark, sf_dir, "v_pages").select("host")
    return hosts.select(F.concat(F.lit("HTTP://"), F.upper("host"), F.lit("/index")).alias("line"), F.lit("urlhaus").alias("source")).unionByName(
        hosts.select(F.col("host").alias("line"), F.lit("manual").alias("source")))


@query("pipeline_verdicts", _WHOLE_PATH, _ALL_VIEWS)
def q_pipeline_verdicts(spark, sf_dir):
    """The whole path: raw lines, dedup, brand, gates, all captures, rules, verdict, sink, read back."""
    from lurewatch.plans.triage import triage
    from lurewatch.sources.sinks import read_verdicts, write_verdicts
    root = _scratch(spark, "pipeline")
    write_verdicts(triage(_page_lines(spark, sf_dir), _caps(spark, sf_dir), R, _as_of(), watched=_WATCHED), root)
    return read_verdicts(spark, root)


@query("stream_with_captures", _WHOLE_PATH, _ALL_VIEWS)
def q_stream_with_captures(spark, sf_dir):
    """Hosts arrive before their captures: the first run leaves them pending, two more settle those whose capture has come."""
    from lurewatch.plans.triage import Captures
    from lurewatch.sources.sinks import read_verdicts
    from lurewatch.streaming.triage import settle, start_triage, stream_hosts
    root = _scratch(spark, "stream-captures")
    lines = _page_lines(spark, sf_dir).select(F.col("line").alias("value"))
    every = _caps(spark, sf_dir)
    half = lambda k: replace(every, http=every.http.where(F.pmod(F.xxhash64("host"), F.lit(2)) == k))
    for captures in (Captures(), half(0), half(1)):
        # each run finds the same lines once more, and the captures that have arrived since the run before
        lines.write.mode("append").text(f"{root}/landing/manual")
        hosts = stream_hosts(spark, f"{root}/landing", [("manual", False)])
        start_triage(spark, hosts, lambda c=captures: c, R, _as_of(), f"{root}/sink", f"{root}/checkpoint", watched=_WATCHED).awaitTermination()
        settle(spark, f"{root}/sink", f"{root}/settled")
    return read_verdicts(spark, f"{root}/settled")


@query("seen_hosts", f"""
WITH l AS (SELECT n, n % 3 AS load, {O.norm_sql('line')} AS host FROM v_raw)
SELECT host, min(load) AS load FROM l WHERE host <> '' GROUP BY host""", ("v_raw",))
def q_seen_hosts(spark, sf_dir):
    """C11: three loads over one table of seen hosts; of each load the hosts that no earlier one had."""
    from lurewatch.operators.seen import SeenHosts
    root = _scratch(spark, "seen")
    seen = SeenHosts(spark, "seen_" + root.rpartition("-")[2], root)
    raw = _v(spark, sf_dir, "v_raw").select((F.col("n") % 3).alias("load"), normalize_host(F.col("line")).alias("host")).where(F.col("host") != "")
    for load in range(3):
        seen.add(seen.unseen(raw.where(F.col("load") == load).select("host"), load), load)
    return spark.table(seen.table).select("host", "load")


_COLOURS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part"
_PAIRS = """c AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i FROM ({colours}) x),
many AS (SELECT a.i * (SELECT count(*) FROM c) + b.i AS ord, a.w || '-' || b.w AS word, b.w || '-' || a.w AS other FROM c a, c b)"""


@query("brand_index", f"""
WITH {_PAIRS.format(colours=_COLOURS)}, hit AS (
  SELECT v.n, min(m.ord) AS ord FROM v_hosts v JOIN many m ON contains(v.host, m.word) AND NOT contains(v.host, 'login.' || m.word)
  WHERE m.ord < 5000 GROUP BY v.n)
SELECT v.n, v.host, 'Brand ' || hit.ord AS brand FROM v_hosts v LEFT JOIN hit ON hit.n = v.n""", ("v_hosts",))
def q_brand_index(spark, sf_dir):
    """Five thousand brands, one for each pair of words of part names, found through the keyword index."""
    from lurewatch.operators.match import match_brand
    hosts = _v(spark, sf_dir, "v_hosts")
    # the brand list is configuration: at most five thousand pairs of the words of the name dictionary
    words = [r.w for r in spark.table("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().orderBy("w").collect()]
    pairs = [(i * len(words) + j, f"{a}-{b}") for i, a in enumerate(words) for j, b in enumerate(words)][:5000]
    many = R.with_(brands=tuple(Brand(o, f"Brand {o}", (), (w,), (f"login.{w}",)) for o, w in pairs))
    return match_brand(hosts, many).select("n", "host", "brand")


_SHARED_REG = "CASE WHEN n % 5 < 3 THEN 'shared.net' ELSE 'r' || CAST(n % 50 AS VARCHAR) || '.org' END"


@query("registrable_context", f"""
WITH {_RDAP}, {_CT}, own AS (
  SELECT n, host, {_SHARED_REG} AS registrable FROM v_pages
), first AS (
  SELECT registrable, min(n) AS n FROM own GROUP BY registrable
), keyed AS (
  SELECT f.registrable, rd.created, rd.registrar, ctq.cert_count, ctq.earliest_date
  FROM first f JOIN own o ON o.n = f.n JOIN rd ON rd.host = o.host JOIN ctq ON ctq.host = o.host)
SELECT o.n, o.host, o.registrable, k.created, k.registrar, k.cert_count, k.earliest_date
FROM own o JOIN keyed k ON k.registrable = o.registrable""", ("v_pages", "v_rdap", "v_ct"))
def q_registrable_context(spark, sf_dir):
    """Registration and certificate history keyed on a registrable that holds three fifths of the hosts, captured more than once."""
    from lurewatch.operators.captures import ct_history, rdap_fields
    from lurewatch.operators.skew import join_by_count
    own = _v(spark, sf_dir, "v_pages").select("n", "host", F.expr(_SHARED_REG.replace("VARCHAR", "STRING")).alias("registrable"))
    caps = _caps(spark, sf_dir)

    def keyed(captures):
        """Captures by registrable; the one of the least page is the latest."""
        return captures.join(own, "host").withColumn("captured_at", -F.col("n")).drop("host", "n")

    registration, history = rdap_fields(keyed(caps.rdap)), ct_history(keyed(caps.ct))
    joined = join_by_count(own, registration.join(history, "registrable", "full"), "registrable", "host")
    return joined.select("n", "host", "registrable", "registration.created", "registration.registrar", "ct.cert_count", "ct.earliest_date")


@query("filter_counts", f"""
SELECT CAST(count(*) FILTER (WHERE b IS NOT NULL) AS BIGINT) AS relevant,
       CAST(count(*) FILTER (WHERE b IS NULL) AS BIGINT) AS irrelevant
FROM (SELECT {O.brand_sql('host', R)} AS b FROM v_hosts) t""", ("v_hosts",))
def q_filter_counts(spark, sf_dir):
    from lurewatch.operators.match import filter_counts
    return filter_counts(_v(spark, sf_dir, "v_hosts"), R)


@query("redirect_history", f"""
SELECT host, {_hist_sql('hops')} AS history
FROM v_http WHERE variant = 'primary'""", ("v_http",))
def q_redirect_history(spark, sf_dir):
    """Ordered redirect statuses from one row per hop (hop k: 301 if odd, else 302)."""
    from lurewatch.operators.captures import redirect_history
    http = _v(spark, sf_dir, "v_http").where(F.col("variant") == "primary")
    hops = (http.where("hops > 0").select("host", "variant", F.explode(F.sequence(F.lit(1), F.col("hops").cast("int"))).alias("hop"))
                .select("host", "variant", "hop",
                        F.when(F.col("hop") % 2 == 1, F.lit(301)).otherwise(F.lit(302)).alias("status")))
    return redirect_history(hops, http).select("host", F.array_join("history", ",").alias("history"))


def _pyb(x: str) -> str:
    return f"CASE WHEN coalesce({x}, false) THEN 'True' ELSE 'False' END"


# evidence of all 25 rules
_EVIDENCE_RULES = ("forms_and_exfil", "phishing_kit", "favicon_brand_mismatch", "inactive_domain", "parking_detect",
                   "long_lived_or_verified", "brand_lookalike", "domain_age", "punycode", "forbidden_tokens",
                   "redirect_and_cloaking", "cert_age", "brand_content_density", "https_login",
                   "suspicious_tld", "title_brand_mismatch", "bulletproof_host", "ct_history",
                   "dns_email_posture", "tls_cert", "subdomain_depth", "missing_security_headers", "freemail_mx",
                   "reverse_dns_mismatch", "no_robots_txt")


_RATIO_SQL = ("CASE WHEN g.html = '' AND g.alt_html = '' THEN 0.0 WHEN g.html = '' OR g.alt_html = '' THEN 1.0 "
              "WHEN len(g.ta) = 0 AND len(g.tb) = 0 THEN 0.0 "
              "ELSE 1.0 - len(list_intersect(g.ta, g.tb)) / len(list_distinct(list_concat(g.ta, g.tb))) END")
_BRAND_WORDS_SQL = f"len(list_filter(g.words, lambda w: list_contains({O.arr(O.DENSITY_WORDS)}, w)))"
_DENSITY_SQL = f"{_BRAND_WORDS_SQL} / len(g.words)"

_SQ = "''''"          # SQL literal: one single quote
_DQ = "'\"'"          # SQL literal: one double quote
_BS = "'\\'"          # SQL literal: one backslash


def _repr_sql(x: str) -> str:
    """Python repr of a string (quote choice; backslash, quote, tab, newline, CR escapes)."""
    esc = (f"replace(replace(replace(replace({x}, {_BS}, {_BS} || {_BS}), chr(10), {_BS} || 'n'), "
           f"chr(13), {_BS} || 'r'), chr(9), {_BS} || 't')")
    return (f"CASE WHEN contains({x}, {_SQ}) AND NOT contains({x}, {_DQ}) THEN {_DQ} || {esc} || {_DQ} "
            f"ELSE {_SQ} || replace({esc}, {_SQ}, {_BS} || {_SQ}) || {_SQ} END")


def _evidence_sql() -> str:
    fl = {name: (i, s_, b_, u_) for i, name, w, s_, b_, u_ in _flags()}
    fm_hit = O.contains_any_sql("rtrim(lower(m), '.')", _FREEMAIL, False)
    fm = f"list_filter(string_split(g.mx, ','), lambda m: m <> '' AND {fm_hit})[1]"
    hh = O.contains_any_sql("lower(g.host)", R.content_tokens, False)
    ch = O.contains_any_sql("g.lo", R.content_tokens, False)
    many_a = f"g.n_a >= {R.thresholds.fast_flux_min_a}"
    low_ttl = f"coalesce(g.ttl_min < {R.thresholds.fast_flux_max_ttl}, false)"
    quote = "''''"   # SQL literal holding one single quote
    ev = {
        "forms_and_exfil": ("'password=' || " + _pyb("g.pw") + " || ',otp=' || " + _pyb("g.otp") + " || ',cc=' || "
                            + _pyb("g.cc") + " || ',cross_post=' || " + _pyb("g.xpost") + " || ',exfil=' || "
                            + _pyb("g.exfil") + " || ',js_obf=' || " + _pyb("g.js OR g.ent") + " || ',wallet=' || "
                            + _pyb("g.wallet") + " || ',clipboard=' || " + _pyb("g.clip")),
        "phishing_kit": ("CASE WHEN g.kit THEN 'kit_comment=True,path_hit=' || " + _pyb("g.path_hit")
                         + " ELSE 'path_hit=True' END"),
        "favicon_brand_mismatch": "'favicon_sha1=' || g.sha1",
        "inactive_domain": ("CASE WHEN NOT (g.status >= 200 AND g.status < 300) THEN 'http_status=' || "
                            "CAST(g.status AS VARCHAR) ELSE 'dns_no_records' END"),
        "parking_detect": "'parking_signature'",
        "long_lived_or_verified": ("CASE WHEN g.cert_err IS NULL AND coalesce(g.org, '') <> '' THEN "
                                   "'ov_ev_cert_org=' || g.org ELSE 'hsts_present' END"),
        "brand_lookalike": ("'lookalike_to_' || g.lk_kind || ':' || g.lk_target || ',dist=' || "
                            "CAST(g.lk_dist AS VARCHAR)"),
        "domain_age": "'age_days=' || CAST(g.reg_age AS VARCHAR)",
        "punycode": "'punycode_label_detected'",
        "forbidden_tokens": "'host_hit=' || " + _pyb(hh) + " || ',content_hit=' || " + _pyb(ch),
        "cert_age": "'cert_age_days=' || CAST(g.cert_age AS VARCHAR)",
        "redirect_and_cloaking": ("'redirects=[' || array_to_string(list_transform(range(1, g.hops + 1), "
                                  "lambda k: CASE WHEN k % 2 = 1 THEN 301 ELSE 302 END), ', ') || "
                                  "'],ua_diff_ratio=' || printf('%.2f', " + _RATIO_SQL + ")"),
        "brand_content_density": ("'brand_density=' || printf('%.3f', " + _DENSITY_SQL + ") || ',brand_count=' || "
                                  "CAST(" + _BRAND_WORDS_SQL + " AS VARCHAR) || ',total_words=' || "
                                  "CAST(len(g.words) AS VARCHAR)"),
        "https_login": "'password_field=True,final_url=' || g.final_url",
        "title_brand_mismatch": ("'brand=' || " + _repr_sql("g.title_brand") + " || ',title=' || "
                                 + _repr_sql("substr(g.title, 1, 60)")),
        "suspicious_tld": "'tld=' || lower(g.suffix)",
        "bulletproof_host": "'cname_target=' || " + quote + " || g.bp_hit || " + quote,
        "ct_history": ("CASE WHEN g.cert_count = 1 THEN 'cert_count=1' ELSE 'cert_count=' || "
                       "CAST(g.cert_count AS VARCHAR) || ',age_days=' || CAST(g.reg_age AS VARCHAR) END"),
        "dns_email_posture": ("'many_a=' || " + _pyb(many_a) + " || ',low_ttl=' || " + _pyb(low_ttl)
                              + " || ',has_mx=' || " + _pyb("g.mx <> ''") + " || ',spf_weak=' || "
                              + _pyb("contains(lower(g.spf), '+all') OR contains(lower(g.spf), '~all')")
                              + " || ',dmarc_weak=' || "
                              + _pyb("g.dmarc = '' OR contains(lower(g.dmarc), 'p=none')")),
        "tls_cert": "'cn_brand_mismatch=True,cn=' || g.cn",
        "subdomain_depth": ("'label_count=' || CAST(len(list_filter(string_split(g.host, '.'), "
                            "lambda x: x <> '')) AS VARCHAR)"),
        "missing_security_headers": O.q("missing=['content-security-policy', 'x-content-type-options', "
                                        "'x-frame-options']"),
        "freemail_mx": f"'freemail_mx=' || {fm}",
        "reverse_dns_mismatch": "'no_ptr_for_' || CAST(g.n_a AS VARCHAR) || '_a_records'",
        "no_robots_txt": "'no_robots_txt_on_active_domain'",
    }
    parts = []
    for name in _EVIDENCE_RULES:
        i, s_, b_, u_ = fl[name]
        fired = " OR ".join(f"coalesce(r.{x}, false)" for x in (s_, b_, u_) if x)
        parts.append(f"SELECT r.host, {O.q(name)} AS name, {ev[name]} AS evidence FROM r JOIN g ON g.host = r.host "
                     f"WHERE {fired}")
    return " UNION ALL ".join(parts)


@query("evidence_strings", f"""
WITH RECURSIVE {_CTX}, ev AS ({_evidence_sql()})
SELECT host, name, evidence FROM ev""", _ALL_VIEWS)
def q_evidence_strings(spark, sf_dir):
    """Evidence text of every fired rule."""
    from lurewatch.operators.verdict import explain_long
    out = explain_long(_context(spark, sf_dir), R, _as_of())
    return out.select("host", "name", "evidence")
