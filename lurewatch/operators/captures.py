"""Capture roll-ups (D1-D17): captured network payloads re-aimed as Spark jobs.

Every roll-up returns exactly one row per key (``host`` or ``registrable``),
so the context assembly is a chain of many-to-one left joins.  Roll-ups that
group by ``host`` leave their output hash-partitioned on ``host``; the
context joins on the same key then reuse that partitioning instead of
re-shuffling.  No roll-up shuffles page bodies: ``page_features`` reduces
each body to a small struct map-side, before ``capture_pair`` groups.

Input schemas (all explicit):

* ``http_captures(host, variant, url, status INT, headers MAP<STRING,STRING>,
  html STRING, history ARRAY<INT>, final_url STRING, elapsed_ms DOUBLE
  [, captured_at TIMESTAMP])`` with ``variant`` in primary / alternative / robots
* ``dns_records(host, qname, rdtype, pos INT, rdata, ttl INT, rcode)``
* ``ptr_records(ip, target [, pos INT])``
* ``cert_captures(host, body STRING, error STRING)``
* ``rdap_captures(registrable, status INT, body STRING)``
* ``favicon_captures(host, status INT, content BINARY)``
* ``cname_records(src, target [, pos INT])``
* ``ct_captures(registrable, status INT, body STRING)``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lurewatch.operators.skew import join_by_count
from lurewatch.sources.store import materialise

OK_RCODES = ("NOERROR", "NODATA")

# Input schemas of the capture tables (used for typed empty inputs as well).
HTTP_SCHEMA = ("host string, variant string, url string, status int, headers map<string,string>, html string, "
               "history array<int>, final_url string, elapsed_ms double")
DNS_SCHEMA = "host string, qname string, rdtype string, pos int, rdata string, ttl int, rcode string"
PTR_SCHEMA = "ip string, target string"
CERT_INPUT_SCHEMA = "host string, body string, error string"
RDAP_SCHEMA = "{key} string, status int, body string"
FAVICON_SCHEMA = "host string, status int, content binary"
CNAME_SCHEMA = "src string, target string"
CT_SCHEMA = "{key} string, status int, body string"


def failed_fetch() -> Column:
    """The stub a failed fetch yields (status 500, empty body, headers and history)."""
    return F.struct(
        F.lit(None).cast("string").alias("url"), F.lit(500).alias("status"),
        F.create_map().cast("map<string,string>").alias("headers"), F.lit("").alias("html"),
        F.array().cast("array<int>").alias("history"), F.lit("").alias("final_url"),
        F.lit(0.0).alias("elapsed_ms"))


def latest_per_key(df: DataFrame, key: str, order_col: str = "captured_at") -> DataFrame:
    """One row per ``key``: the latest capture by ``order_col`` (or a deterministic pick without it).

    ``max_by`` aggregates partially map-side, so a key holding a large share of
    the rows is reduced before the shuffle; the output is hash-partitioned on
    ``key``, which the following context join on ``key`` reuses.
    """
    rest = [c for c in df.columns if c not in (key, order_col)]
    body = F.struct(*[F.col(c) for c in rest])
    # equal times: the largest row, so that reruns agree
    pick = F.max_by(body, F.struct(F.col(order_col), body)) if order_col in df.columns else F.max(body)
    return df.groupBy(key).agg(pick.alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def _parsed(df: DataFrame, key: str, *columns: Column, order_col: str = "captured_at") -> DataFrame:
    """Small parsed columns of each capture, reduced to the latest per key: bodies are read map-side and never shuffled."""
    order = [F.col(order_col)] if order_col in df.columns else []
    return latest_per_key(df.select(key, *order, *columns), key, order_col)


def latest_snapshot(records: DataFrame, key: str = "host", order_col: str = "captured_at") -> DataFrame:
    """Rows of the latest snapshot per ``key`` when snapshots carry ``order_col``; all rows otherwise."""
    if order_col not in records.columns:
        return records
    last = records.groupBy(key).agg(F.max(order_col).alias(order_col))
    return records.join(last, [key, order_col], "left_semi")


def lower_keys(headers: Column) -> Column:
    """D3: header names lower-cased (LAST_WIN dedup policy set on the session)."""
    return F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")),
                            lambda k, v: F.lower(k))


def capture_pair(captures: DataFrame, payload: list[str] | None = None,
                 order_col: str | None = "captured_at", robots_body: str = "html") -> DataFrame:
    """One row per host with ``primary``, ``alternative`` structs and ``robots`` text.

    ``payload`` lists the capture columns carried in the structs (default: the
    fetch columns).  When a host has several captures of a variant the latest
    (by ``order_col``, then by a hash of the payload, so that reruns agree) wins; a missing variant is null (rules then read it as
    the failed-fetch stub: status unknown, empty body).  ``robots`` is the
    robots body when its status is 200 and the body is non-empty.
    """
    cols = payload or ["url", "status", "headers", "html", "history", "final_url", "elapsed_ms"]
    has_order = order_col is not None and order_col in captures.columns
    # maps have neither an order nor a hash of their own
    plain = [F.array_sort(F.map_entries(c)) if isinstance(captures.schema[c].dataType, MapType) else F.col(c) for c in dict.fromkeys([*cols, robots_body])]
    order = F.struct(*([F.col(order_col)] if has_order else []), F.xxhash64(*plain))
    body = F.struct(*[F.col(c) for c in cols])

    def latest(variant: str) -> Column:
        return F.max_by(body, F.when(F.col("variant") == variant, order))

    agg = captures.groupBy("host").agg(
        latest("primary").alias("primary"),
        latest("alternative").alias("alternative"),
        F.max_by(F.struct(F.col("status"), F.col(robots_body).alias("body")),
                 F.when(F.col("variant") == "robots", order)).alias("_robots"))
    robots = F.when((F.col("_robots.status") == 200) & (F.coalesce(F.col("_robots.body"), F.lit("")) != ""),
                    F.col("_robots.body"))
    return agg.withColumn("robots", robots).drop("_robots")


def redirect_history(hops: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """``hops(host, variant, hop INT, status INT)`` -> ordered ``history`` array (bounded by the client's redirect limit).

    With ``fetches(host, variant)`` every fetch has a row: an empty list if it was not redirected.
    """
    found = (hops.groupBy("host", "variant")
                 .agg(F.sort_array(F.collect_list(F.struct("hop", "status"))).alias("_h"))
                 .select("host", "variant", F.col("_h.status").alias("history")))
    if fetches is None:
        return found
    empty = F.array().cast(found.schema["history"].dataType)
    return (fetches.select("host", "variant").distinct().join(found, ["host", "variant"], "left")
                   .select("host", "variant", F.coalesce("history", empty).alias("history")))


def dns_snapshot(dns_records: DataFrame) -> DataFrame:
    """Per host A / AAAA / MX / NS / SPF / DMARC lists, min TTL, error collapse.

    The lists are collected per host from the latest snapshot only; each comes
    from one DNS answer, whose size the protocol bounds (65,535 bytes), so a
    list is bounded whatever the data volume or key skew.  Counts, minima and
    flags are plain aggregates.
    """
    r = latest_snapshot(dns_records)
    at_host = F.col("qname") == F.col("host")
    at_dmarc = F.col("qname") == F.concat(F.lit("_dmarc."), F.col("host"))
    ok = F.col("rcode").isin(*OK_RCODES)
    has_data = ok & F.col("rdata").isNotNull()

    def ordered(cond: Column) -> Column:
        return F.transform(
            F.sort_array(F.collect_list(F.when(cond & has_data, F.struct(F.col("pos"), F.col("rdata"))))),
            lambda x: x["rdata"])

    agg = r.groupBy("host").agg(
        ordered(at_host & (F.col("rdtype") == "A")).alias("a_records"),
        ordered(at_host & (F.col("rdtype") == "AAAA")).alias("aaaa_records"),
        ordered(at_host & (F.col("rdtype") == "MX")).alias("mx"),
        ordered(at_host & (F.col("rdtype") == "NS")).alias("ns"),
        ordered(at_host & (F.col("rdtype") == "TXT") & F.lower(F.col("rdata")).contains("spf1")).alias("spf"),
        ordered(at_dmarc & (F.col("rdtype") == "TXT") & F.col("rdata").contains("DMARC1")).alias("dmarc"),
        F.min(F.when(at_host & F.col("rdtype").isin("A", "AAAA") & has_data, F.col("ttl"))).alias("ttl_min"),
        F.min(F.when(~ok, F.concat(F.col("rcode"), F.lit(": "), F.col("qname")))).alias("error"))
    empty = F.array().cast("array<string>")
    err = F.col("error").isNotNull()
    lists = ["a_records", "aaaa_records", "mx", "ns", "spf", "dmarc"]
    return agg.select("host", *[F.when(err, empty).otherwise(F.col(c)).alias(c) for c in lists],
                      F.when(err, F.lit(None)).otherwise(F.col("ttl_min")).alias("ttl_min"), "error")


def ptr_rollup(snapshot: DataFrame, ptr_records: DataFrame) -> DataFrame:
    """PTR names of the host's A records, first-seen order, distinct.

    PTR answers are first reduced to one row per address, so re-captures don't
    multiply and the join is many-to-one.  Bounded per host by (A records of one
    answer) x (distinct PTR names per address).

    Returns ``(host, ptr_records)`` for hosts with at least one PTR answer.
    """
    a = snapshot.select("host", F.posexplode("a_records").alias("a_pos", "ip"))
    p = ptr_records if "pos" in ptr_records.columns else ptr_records.withColumn("pos", F.lit(0))
    once = p.groupBy("ip", "target").agg(F.min("pos").alias("pos"))
    names = once.groupBy("ip").agg(F.sort_array(F.collect_list(F.struct("pos", "target"))).alias("_t"))
    j = join_by_count(a, names, "ip", "host", how="inner")
    return (j.groupBy("host")
             .agg(F.sort_array(F.collect_list(F.struct("a_pos", "_t"))).alias("_p"))
             .select("host", F.array_distinct(F.flatten(F.transform("_p", lambda x: x["_t"]["target"]))).alias("ptr_records")))


def dns_info(dns_records: DataFrame, ptr_records: DataFrame) -> DataFrame:
    """D5-D10 together: one ``dns`` struct per host."""
    snap = dns_snapshot(dns_records)
    ptr = ptr_rollup(snap, ptr_records)
    j = snap.join(ptr, "host", "left")
    empty = F.array().cast("array<string>")
    return j.select("host", F.struct(
        "a_records", "aaaa_records", "mx", "ns", "spf", "dmarc", "ttl_min", "error",
        F.coalesce(F.col("ptr_records"), empty).alias("ptr_records")).alias("dns"))


CERT_SCHEMA = ("struct<subject:array<array<array<string>>>, subjectAltName:array<array<string>>, "
               "notBefore:string, notAfter:string>")


def _first_attr(subject: Column, name: str) -> Column:
    rdn = F.get(F.filter(subject, lambda r: F.get(F.get(r, 0), 0) == name), 0)
    return F.get(F.get(rdn, 0), 1)


def cert_fields(cert_captures: DataFrame) -> DataFrame:
    """CN / O from the first RDN whose first attribute has that name; SAN values; dates."""
    c = F.from_json(F.col("body"), CERT_SCHEMA)
    err = F.col("error").isNotNull()
    subj = F.coalesce(c["subject"], F.array().cast("array<array<array<string>>>"))
    return _parsed(cert_captures, "host", F.struct(
        F.when(~err, _first_attr(subj, "commonName")).alias("cn"),
        F.when(~err, F.transform(F.coalesce(c["subjectAltName"], F.array().cast("array<array<string>>")),
                                 lambda x: F.get(x, 1))).otherwise(F.array().cast("array<string>")).alias("san"),
        F.when(~err, _first_attr(subj, "organizationName")).alias("org"),
        F.when(~err, c["notBefore"]).alias("not_before"),
        F.when(~err, c["notAfter"]).alias("not_after"),
        F.col("error").alias("error")).alias("cert"))


def _first_character(body: Column) -> Column:
    """First character that isn't white space: tells a JSON object from a list."""
    return F.regexp_extract(body, r"^\s*(\S)", 1)


def rdap_fields(rdap: DataFrame, key: str = "registrable") -> DataFrame:
    """Registration date (first ``registration`` event) and registrar (``fn`` of the first registrar entity)."""
    body = F.coalesce(F.col("body"), F.lit(""))
    bad_status = (F.col("status") != 200) | (body == "")
    # members of unlike kinds (the card's entries) are read as JSON text and parsed again
    v = F.from_json(body, "events array<struct<eventAction:string,eventDate:string>>, "
                          "entities array<struct<roles:array<string>,vcardArray:array<string>>>")
    created = F.get(F.filter(F.coalesce(v["events"], F.array().cast("array<struct<eventAction:string,eventDate:string>>")),
                             lambda e: e["eventAction"] == "registration"), 0)["eventDate"]
    registrar_entity = F.get(F.filter(v["entities"], lambda e: F.coalesce(F.array_contains(e["roles"], F.lit("registrar")), F.lit(False))), 0)
    vcard = F.from_json(F.get(registrar_entity["vcardArray"], 1), "array<array<string>>")
    registrar = F.get(F.get(F.filter(vcard, lambda f: F.get(f, 0) == "fn"), 0), 3)
    error = (F.when(bad_status, F.concat(F.lit("http_status="), F.col("status").cast("string")))
              .when(F.get_json_object(body, "$").isNull(), F.lit("invalid json"))
              .when(_first_character(body) != "{", F.lit("unexpected json")))
    return _parsed(rdap, key, F.struct(
        F.when(error.isNull(), created).alias("created"),
        F.when(error.isNull(), registrar).alias("registrar"),
        error.alias("error")).alias("registration"))


def favicon_fields(favicons: DataFrame) -> DataFrame:
    """SHA-1 hex of a non-empty 200 response, else an error."""
    ok = (F.col("status") == 200) & F.coalesce(F.length("content") > 0, F.lit(False))
    return _parsed(favicons, "host", F.struct(
        F.when(ok, F.sha1(F.col("content"))).alias("sha1"),
        F.when(~ok, F.concat(F.lit("http_status="), F.col("status").cast("string"))).alias("error")
    ).alias("favicon"))


def cname_chains(hosts: DataFrame, cname_records: DataFrame, max_hops: int = 10) -> DataFrame:
    """Follow CNAME answers from each host up to ``max_hops``.

    Each hop takes the first answer (lowest ``pos``), keeps the trailing dot in
    the chain and strips it for the next lookup; the chain ends when a name has
    no answer, and a loop goes round until the hops are used up.

    Pointer doubling: the edges are written once (one row per source), and a
    round joins the table with itself, so that it leads 1, 2, 4, 8 hops ahead.
    The hosts then take the jumps whose lengths add up to ``max_hops``: ten hops
    are three rounds and two jumps.  A name that many others point to is dealt
    over tasks by its count, in rounds and jumps alike.
    """
    edges = cname_records
    order = F.struct("pos", "target") if "pos" in edges.columns else F.col("target")
    ahead = edges.groupBy("src").agg(F.min_by("target", order).alias("_next")).where(F.col("_next").isNotNull())
    jump = materialise(ahead.select("src", F.array("_next").alias("_chain"), F.regexp_replace("_next", "\\.+$", "").alias("_end")), "cname-edges")

    def follow(walk: DataFrame, name: str) -> DataFrame:
        """``walk`` (name, _chain, _end) after one more jump from ``_end``; where there is none it stays."""
        onward = jump.select(F.col("src").alias("_end"), F.col("_chain").alias("_more"), F.col("_end").alias("_there"))
        step = join_by_count(walk, onward, "_end", name)
        return step.select(name, F.concat("_chain", F.coalesce("_more", F.array().cast("array<string>"))).alias("_chain"), F.coalesce("_there", "_end").alias("_end"))

    walk = hosts.select("host").distinct().select("host", F.array().cast("array<string>").alias("_chain"), F.col("host").alias("_end"))
    hops = max_hops
    while hops:
        if hops & 1:
            walk = materialise(follow(walk, "host"), "cname-walk")
        hops >>= 1
        if hops:
            jump = materialise(follow(jump, "src"), "cname-jumps")  # written, as the next round reads it twice
    return walk.select("host", F.struct(F.col("_chain").alias("chain"), F.lit(None).cast("string").alias("error")).alias("cname"))


def ct_history(ct: DataFrame, key: str = "registrable") -> DataFrame:
    """Certificate count and earliest ``not_before``/``entry_timestamp`` (string minimum)."""
    body = F.coalesce(F.col("body"), F.lit(""))
    bad_status = (F.col("status") != 200) | (body == "")
    is_list = _first_character(body) == "["
    # members as JSON text, each read on its own
    members = F.when(is_list, F.from_json(body, "array<string>"))
    certs = F.coalesce(members, F.array().cast("array<string>"))
    invalid = F.when(is_list, members.isNull()).otherwise(F.get_json_object(body, "$").isNull())

    def pick(c, field):
        x = F.get_json_object(c, f"$.{field}")
        return F.when(x != "", x)

    dates = F.transform(certs, lambda c: F.coalesce(pick(c, "not_before"), pick(c, "entry_timestamp")))
    # a list member that is not an object cannot be read field-wise: the capture counts as failed
    bad_item = F.exists(certs, lambda c: F.coalesce(_first_character(c) != "{", F.lit(True)))
    error = (F.when(bad_status, F.concat(F.lit("http_status="), F.col("status").cast("string")))
              .when(invalid, F.lit("invalid json"))
              .when(is_list & bad_item, F.lit("unexpected json")))
    count = F.when(error.isNull() & is_list, F.size(certs)).otherwise(F.lit(0))
    earliest = F.when(error.isNull() & is_list, F.array_min(F.filter(dates, lambda d: d.isNotNull())))
    return _parsed(ct, key, F.struct(count.alias("cert_count"), earliest.alias("earliest_date"), error.alias("error")).alias("ct"))


def ct_history_from_certs(certs: DataFrame) -> DataFrame:
    """D15 over a certificate table ``(registrable, not_before, entry_timestamp)``: partial aggregation, no bodies."""
    d = F.coalesce(F.when(F.col("not_before") != "", F.col("not_before")),
                   F.when(F.col("entry_timestamp") != "", F.col("entry_timestamp")))
    return certs.groupBy("registrable").agg(F.struct(
        F.count(F.lit(1)).cast("int").alias("cert_count"), F.min(d).alias("earliest_date"),
        F.lit(None).cast("string").alias("error")).alias("ct"))
