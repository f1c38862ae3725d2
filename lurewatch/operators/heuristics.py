"""The 25 ordered, weighted rules (H01-H25) as Column expressions, and the rule registry.

Each rule is ``Rule(name, weight, outcome)`` where ``outcome(ctx)`` returns a
``struct<scam, benign, suspicious, evidence>`` Column over the context
DataFrame built by ``plans.triage.build_context``:

* ``host``, ``registrable``, ``suffix``
* ``primary`` / ``alternative``: ``struct<status, headers, history, final_url, f>``
  where ``f`` is the page-feature struct of ``operators.features``
* ``robots`` (string), ``dns``, ``cert``, ``registration``, ``favicon``,
  ``cname``, ``ct`` (nullable structs; a null capture makes its rules neutral)

All rules are evaluated in one projection; flags are null-safe (``coalesce``
to false) so three-valued logic never leaks into the tally.  ``as_of`` is a
parameter.  Python-only rules can be registered with ``python_rule`` (a
``pandas_udf`` returning the same struct).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.functions import dates as dt
from lurewatch.functions import text as tx
from lurewatch.functions.hosts import contains_any, first_hit, first_label, idna_host, is_punycode, label_count, skeleton
from lurewatch.operators.suffix import brand_registrables
from lurewatch.rules import FREEMAIL_PROVIDERS, PARKING_POWERED_BY, PARKING_SERVERS, RULE_ORDER, \
    SECURITY_HEADERS, RuleSet, skeleton_py

RESULT_TYPE = "struct<scam:boolean,benign:boolean,suspicious:boolean,evidence:string>"


@dataclass(frozen=True)
class RuleContext:
    rules: RuleSet
    as_of: Column
    with_evidence: bool = True

    @property
    def t(self):
        return self.rules.thresholds


@dataclass(frozen=True)
class Rule:
    name: str
    weight: int
    outcome: Callable[[RuleContext], Column]
    can_fail: bool = False  # the outcome has an ``error`` field


def _b(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def result(ctx: RuleContext, scam: Column | None = None, benign: Column | None = None,
           suspicious: Column | None = None, evidence: Column | None = None) -> Column:
    """G1: tri-state result; a definitive flag masks the weaker ones.

    Evidence text is only built when ``ctx.with_evidence`` (verdict-only plans stay small).
    """
    if not ctx.with_evidence:
        evidence = None
    s = _b(scam) if scam is not None else F.lit(False)
    b = (_b(benign) & ~s) if benign is not None else F.lit(False)
    u = (_b(suspicious) & ~s & ~b) if suspicious is not None else F.lit(False)
    ev = F.when(s | b | u, evidence) if evidence is not None else F.lit(None).cast("string")
    return F.struct(s.alias("scam"), b.alias("benign"), u.alias("suspicious"), ev.alias("evidence"))


def _pf(field: str) -> Column:
    return F.col("primary.f")[field]


def _hdr(name: str) -> Column:
    return F.coalesce(F.element_at(F.col("primary.headers"), F.lit(name)), F.lit(""))


def _has_hdr(name: str) -> Column:
    return _b(F.map_contains_key(F.col("primary.headers"), F.lit(name)))


def _no_error(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _owned_any(rules: RuleSet) -> Column:
    regs = sorted({r for rs in brand_registrables(rules).values() for r in rs})
    return _b(F.col("registrable").isin(regs)) if regs else F.lit(False)


def _owned(rules: RuleSet, brand_ord: int) -> Column:
    regs = list(brand_registrables(rules)[brand_ord])
    return _b(F.col("registrable").isin(regs)) if regs else F.lit(False)


# --- definitive scam -------------------------------------------------------

def forms_and_exfil(ctx: RuleContext) -> Column:
    pw, otp, cc = _b(_pf("password")), _b(_pf("otp")), _b(_pf("card"))
    xpost, exfil = _b(_pf("cross_post")), _b(_pf("exfil"))
    obf, ent = _b(_pf("js_obf")), _b(_pf("high_entropy"))
    wallet, clip = _b(_pf("wallet")), _b(_pf("clipboard"))
    ev = F.concat(F.lit("password="), tx.py_bool(pw), F.lit(",otp="), tx.py_bool(otp), F.lit(",cc="), tx.py_bool(cc),
                  F.lit(",cross_post="), tx.py_bool(xpost), F.lit(",exfil="), tx.py_bool(exfil),
                  F.lit(",js_obf="), tx.py_bool(obf | ent), F.lit(",wallet="), tx.py_bool(wallet),
                  F.lit(",clipboard="), tx.py_bool(clip))
    return result(ctx, scam=(pw | cc) & (exfil | xpost), suspicious=pw | otp | cc | obf | ent | wallet | clip, evidence=ev)


def phishing_kit(ctx: RuleContext) -> Column:
    path_hit = contains_any(F.lower(F.col("primary.final_url")), ctx.rules.kit_paths, normalise=False)
    kit = _b(_pf("kit_comment"))
    ev = F.when(kit, F.concat(F.lit("kit_comment=True,path_hit="), tx.py_bool(path_hit))).otherwise(
        F.lit("path_hit=True"))
    return result(ctx, scam=kit, suspicious=path_hit, evidence=ev)


def favicon_brand_mismatch(ctx: RuleContext) -> Column:
    hashes = list(ctx.rules.favicon_hashes)
    sha = F.col("favicon.sha1")
    known = _b(sha.isin(hashes)) if hashes else F.lit(False)
    fire = F.col("favicon").isNotNull() & _no_error(F.col("favicon.error")) & known & ~_owned_any(ctx.rules)
    return result(ctx, scam=fire, evidence=F.concat(F.lit("favicon_sha1="), sha))


# --- definitive benign -----------------------------------------------------

def inactive_domain(ctx: RuleContext) -> Column:
    st = F.col("primary.status")
    bad_http = F.col("primary").isNotNull() & ~((st >= 200) & (st < 300))
    d = F.col("dns")
    no_records = d.isNotNull() & (F.size(d["a_records"]) + F.size(d["aaaa_records"]) == 0) & \
        (F.size(d["mx"]) + F.size(d["ns"]) == 0)
    ev = F.when(bad_http, F.concat(F.lit("http_status="), st.cast("string"))).otherwise(F.lit("dns_no_records"))
    return result(ctx, benign=_b(bad_http) | _b(no_records), evidence=ev)


def parking_detect(ctx: RuleContext) -> Column:
    server, powered = F.lower(_hdr("server")), F.lower(_hdr("x-powered-by"))
    parked = contains_any(server, PARKING_SERVERS, normalise=False) | powered.contains(PARKING_POWERED_BY)
    return result(ctx, benign=_b(_pf("parking_sig")) | parked, evidence=F.lit("parking_signature"))


def long_lived_or_verified(ctx: RuleContext) -> Column:
    c = F.col("cert")
    org = c.isNotNull() & (F.coalesce(c["org"], F.lit("")) != "") & _no_error(c["error"])
    hsts = _has_hdr("strict-transport-security")
    ev = F.when(_b(org), F.concat(F.lit("ov_ev_cert_org="), c["org"])).otherwise(F.lit("hsts_present"))
    return result(ctx, benign=_b(org) | hsts, evidence=ev)


# --- suspicious ------------------------------------------------------------

def lookalike_targets(rules: RuleSet) -> list[tuple[int, int, str, str, str]]:
    """(brand ord, position, kind, target, skeleton) in evaluation order, per candidate."""
    out = []
    for b in sorted(rules.brands, key=lambda x: x.ord):
        name = b.name.lower()
        pos = 0
        if name:
            out.append((b.ord, pos, "name", name, skeleton_py(name)))
            pos += 1
        for d in b.canonical_domains:
            first = d.lower().split(".")[0]
            out.append((b.ord, pos, "domain", first, skeleton_py(first)))
            pos += 1
    return out


def lookalike_best(host: Column, registrable: Column, rules: RuleSet) -> Column:
    """Min over brands x {host, registrable} x targets of the confusable distance.

    Ties keep the earliest (brand, candidate, target) in evaluation order; distances
    above the limit are null (3-argument ``levenshtein`` stops early).
    """
    limit = rules.thresholds.lookalike_max_distance
    targets = lookalike_targets(rules)
    # the four texts that targets are compared with: whole and first label of either candidate
    forms = F.transform(F.array(F.lower(idna_host(F.coalesce(host, F.lit(""))))),
                        lambda h: F.struct(h.alias("host"), F.coalesce(F.lower(F.nullif(registrable, F.lit(""))), h).alias("registrable")))
    texts = F.flatten(F.transform(forms, lambda x: F.array(*[skeleton(t) for c in ("host", "registrable") for t in (x[c], first_label(x[c]))])))
    entries = [(o, c, p, kind, target, skel) for o, p, kind, target, skel in targets for c in (0, 1)]
    entries.sort(key=lambda e: e[:3])
    rows = [{"text": 2 * c + (kind != "name"), "ord": i, "kind": kind, "target": target, "skel": skel, "len": len(skel)}
            for i, (_, c, _, kind, target, skel) in enumerate(entries)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<text:int,ord:int,kind:string,target:string,skel:string,len:int>>")

    def nearest(t: Column) -> Column:
        def score(e: Column) -> Column:
            # lengths that differ by more than the limit can't be near
            d = F.when(F.abs(F.length(F.get(t, e["text"])) - e["len"]) <= limit, F.levenshtein(F.get(t, e["text"]), e["skel"], limit))
            return F.when(d >= 0, F.struct(d.alias("dist"), e["ord"].alias("ord"), e["kind"].alias("kind"), e["target"].alias("target")))
        return F.array_min(F.transform(table, score))

    return F.get(F.transform(F.array(texts), nearest), 0)


def brand_lookalike(ctx: RuleContext) -> Column:
    best = F.col("_lookalike")
    ev = F.concat(F.lit("lookalike_to_"), best["kind"], F.lit(":"), best["target"], F.lit(",dist="),
                  best["dist"].cast("string"))
    return result(ctx, suspicious=best.isNotNull() & (best["dist"] <= ctx.t.lookalike_max_distance), evidence=ev)


def _registration_age(ctx: RuleContext) -> Column:
    r = F.col("registration")
    valid = r.isNotNull() & _no_error(r["error"]) & (F.coalesce(r["created"], F.lit("")) != "")
    return F.when(valid, dt.age_days(dt.parse_iso(r["created"]), ctx.as_of))


def domain_age(ctx: RuleContext) -> Column:
    age = F.col("_reg_age")
    return result(ctx, suspicious=age < ctx.t.new_domain_days, evidence=F.concat(F.lit("age_days="), age.cast("string")))


def punycode(ctx: RuleContext) -> Column:
    return result(ctx, suspicious=is_punycode(F.col("host")), evidence=F.lit("punycode_label_detected"))


def forbidden_tokens(ctx: RuleContext) -> Column:
    host_hit = contains_any(F.lower(F.col("host")), ctx.rules.content_tokens, normalise=False)
    content_hit = _b(_pf("content_token_hit"))
    ev = F.concat(F.lit("host_hit="), tx.py_bool(host_hit), F.lit(",content_hit="), tx.py_bool(content_hit))
    return result(ctx, suspicious=host_hit | content_hit, evidence=ev)


def diff_ratio_of_pair() -> Column:
    p, a = F.col("primary.f"), F.col("alternative.f")
    pe, ae = F.coalesce(p["html_len"], F.lit(0)) == 0, F.coalesce(a["html_len"], F.lit(0)) == 0
    ps = F.coalesce(p["token_set"], F.array().cast("array<string>"))
    as_ = F.coalesce(a["token_set"], F.array().cast("array<string>"))
    inter = F.size(F.array_intersect(ps, as_))
    union = F.size(F.array_union(ps, as_))
    return (F.when(pe & ae, F.lit(0.0)).when(pe | ae, F.lit(1.0))
             .when((F.size(ps) == 0) & (F.size(as_) == 0), F.lit(0.0))
             .otherwise(F.lit(1.0) - inter / union))


def redirect_and_cloaking(ctx: RuleContext) -> Column:
    hist = F.coalesce(F.col("primary.history"), F.array().cast("array<int>"))
    multi = F.size(hist) >= ctx.t.redirect_min_hops
    ratio = F.col("_diff_ratio")
    mn = ctx.t.cloaking_min_content_len
    long_enough = (F.coalesce(F.col("primary.f.html_len"), F.lit(0)) > mn) | \
        (F.coalesce(F.col("alternative.f.html_len"), F.lit(0)) > mn)
    cloak = (ratio > ctx.t.cloaking_diff_ratio) & long_enough
    ev = F.concat(F.lit("redirects=["), F.array_join(hist, ", "), F.lit("],ua_diff_ratio="),
                  tx.py_fixed(ratio, 2))
    return result(ctx, suspicious=multi | cloak, evidence=ev)


def cert_age(ctx: RuleContext) -> Column:
    c = F.col("cert")
    valid = c.isNotNull() & _no_error(c["error"]) & (F.coalesce(c["not_before"], F.lit("")) != "")
    age = F.when(valid, dt.age_days(dt.parse_cert_date(c["not_before"]), ctx.as_of))
    return result(ctx, suspicious=age < ctx.t.cert_age_days, evidence=F.concat(F.lit("cert_age_days="), age.cast("string")))


def brand_content_density(ctx: RuleContext) -> Column:
    total = F.coalesce(_pf("words_total"), F.lit(0))
    count = F.coalesce(_pf("brand_words"), F.lit(0))
    density = count / total
    fire = ~_owned_any(ctx.rules) & (total > 0) & (density > ctx.t.brand_density_threshold)
    ev = F.concat(F.lit("brand_density="), tx.py_fixed(density, 3), F.lit(",brand_count="),
                  count.cast("string"), F.lit(",total_words="), total.cast("string"))
    return result(ctx, suspicious=fire, evidence=ev)


def https_login(ctx: RuleContext) -> Column:
    url = F.coalesce(F.col("primary.final_url"), F.lit(""))
    fire = _b(_pf("password")) & url.startswith("http://")
    return result(ctx, suspicious=fire, evidence=F.concat(F.lit("password_field=True,final_url="), url))


def suspicious_tld(ctx: RuleContext) -> Column:
    tld = F.lower(F.coalesce(F.col("suffix"), F.lit("")))
    tlds = list(ctx.rules.suspicious_tlds)
    fire = tld.isin(tlds) if tlds else F.lit(False)
    return result(ctx, suspicious=fire, evidence=F.concat(F.lit("tld="), tld))


def title_brand_mismatch(ctx: RuleContext) -> Column:
    found = _b(_pf("title_found"))
    tb = F.coalesce(_pf("title_brands"), F.array().cast("array<int>"))
    hit = F.coalesce(*[F.when(F.array_contains(tb, F.lit(b.ord)) & ~_owned(ctx.rules, b.ord), F.lit(b.name))
                       for b in ctx.rules.brands], F.lit(None).cast("string"))
    ev = F.concat(F.lit("brand="), tx.py_repr(hit), F.lit(",title="), tx.py_repr(F.substring(_pf("title_text"), 1, 60)))
    return result(ctx, suspicious=found & hit.isNotNull(), evidence=ev)


def bulletproof_host(ctx: RuleContext) -> Column:
    c = F.col("cname")
    chain = F.coalesce(c["chain"], F.array().cast("array<string>"))
    hit = first_hit(chain, ctx.rules.hosting_substrings)
    fire = c.isNotNull() & _no_error(c["error"]) & hit.isNotNull()
    return result(ctx, suspicious=fire, evidence=F.concat(F.lit("cname_target='"), hit, F.lit("'")))


def ct_history(ctx: RuleContext) -> Column:
    c = F.col("ct")
    n = F.coalesce(c["cert_count"], F.lit(0))
    usable = c.isNotNull() & _no_error(c["error"]) & (n > 0) & (n <= ctx.t.ct_few_certs)
    age = F.col("_reg_age")
    single = usable & (n == 1)
    young = usable & (n > 1) & _b(age < ctx.t.new_domain_days)
    ev = F.when(single, F.lit("cert_count=1")).otherwise(
        F.concat(F.lit("cert_count="), n.cast("string"), F.lit(",age_days="), age.cast("string")))
    return result(ctx, suspicious=single | young, evidence=ev)


def dns_email_posture(ctx: RuleContext) -> Column:
    d = F.col("dns")
    usable = d.isNotNull() & _no_error(d["error"])
    many_a = F.size(d["a_records"]) >= ctx.t.fast_flux_min_a
    low_ttl = _b(d["ttl_min"] < ctx.t.fast_flux_max_ttl)
    has_mx = F.size(d["mx"]) > 0
    spf_weak = F.exists(d["spf"], lambda s: F.lower(s).contains("+all") | F.lower(s).contains("~all"))
    dmarc_weak = (F.size(d["dmarc"]) == 0) | F.exists(d["dmarc"], lambda s: F.lower(s).contains("p=none"))
    fire = usable & (many_a | low_ttl | (has_mx & (spf_weak | dmarc_weak)))
    ev = F.concat(F.lit("many_a="), tx.py_bool(many_a), F.lit(",low_ttl="), tx.py_bool(low_ttl),
                  F.lit(",has_mx="), tx.py_bool(has_mx), F.lit(",spf_weak="), tx.py_bool(_b(spf_weak)),
                  F.lit(",dmarc_weak="), tx.py_bool(_b(dmarc_weak)))
    return result(ctx, suspicious=fire, evidence=ev)


def tls_cert(ctx: RuleContext) -> Column:
    c = F.col("cert")
    cn = F.lower(F.coalesce(c["cn"], F.lit("")))
    names = [b.name.lower() for b in ctx.rules.brands]
    named = F.lit(False)
    for nm in names:
        named = named | cn.contains(nm)
    fire = c.isNotNull() & _no_error(c["error"]) & (cn != "") & named & ~_owned_any(ctx.rules)
    return result(ctx, suspicious=fire, evidence=F.concat(F.lit("cn_brand_mismatch=True,cn="), c["cn"]))


def subdomain_depth(ctx: RuleContext) -> Column:
    n = label_count(F.col("host"))
    return result(ctx, suspicious=n >= ctx.t.subdomain_min_depth, evidence=F.concat(F.lit("label_count="), n.cast("string")))


def missing_security_headers(ctx: RuleContext) -> Column:
    ok = _b(F.col("primary.status") == 200)
    none = F.lit(True)
    for h in SECURITY_HEADERS:
        none = none & ~_has_hdr(h)
    ev = F.lit("missing=[" + ", ".join(f"'{h}'" for h in sorted(SECURITY_HEADERS)) + "]")
    return result(ctx, suspicious=ok & none, evidence=ev)


def freemail_mx(ctx: RuleContext) -> Column:
    d = F.col("dns")
    mx = F.coalesce(d["mx"], F.array().cast("array<string>"))
    hit = F.get(F.filter(mx, lambda m: contains_any(F.regexp_replace(F.lower(m), "\\.+$", ""),
                                                    FREEMAIL_PROVIDERS, normalise=False)), 0)
    fire = d.isNotNull() & _no_error(d["error"]) & hit.isNotNull()
    return result(ctx, suspicious=fire, evidence=F.concat(F.lit("freemail_mx="), hit))


def reverse_dns_mismatch(ctx: RuleContext) -> Column:
    d = F.col("dns")
    n_a = F.size(d["a_records"])
    fire = d.isNotNull() & _no_error(d["error"]) & (n_a > 0) & (F.size(d["ptr_records"]) == 0)
    return result(ctx, suspicious=fire, evidence=F.concat(F.lit("no_ptr_for_"), n_a.cast("string"), F.lit("_a_records")))


def no_robots_txt(ctx: RuleContext) -> Column:
    d = F.col("dns")
    fire = _b(F.col("primary.status") == 200) & d.isNotNull() & (F.size(d["a_records"]) > 0) & \
        F.col("robots").isNull()
    return result(ctx, suspicious=fire, evidence=F.lit("no_robots_txt_on_active_domain"))


_OUTCOMES: dict[str, Callable[[RuleContext], Column]] = {
    "forms_and_exfil": forms_and_exfil, "phishing_kit": phishing_kit,
    "favicon_brand_mismatch": favicon_brand_mismatch, "inactive_domain": inactive_domain,
    "parking_detect": parking_detect, "long_lived_or_verified": long_lived_or_verified,
    "brand_lookalike": brand_lookalike, "domain_age": domain_age, "punycode": punycode,
    "forbidden_tokens": forbidden_tokens, "redirect_and_cloaking": redirect_and_cloaking,
    "cert_age": cert_age, "brand_content_density": brand_content_density, "https_login": https_login,
    "suspicious_tld": suspicious_tld, "title_brand_mismatch": title_brand_mismatch,
    "bulletproof_host": bulletproof_host, "ct_history": ct_history, "dns_email_posture": dns_email_posture,
    "tls_cert": tls_cert, "subdomain_depth": subdomain_depth,
    "missing_security_headers": missing_security_headers, "freemail_mx": freemail_mx,
    "reverse_dns_mismatch": reverse_dns_mismatch, "no_robots_txt": no_robots_txt,
}

DEFAULT_REGISTRY: tuple[Rule, ...] = tuple(Rule(n, w, _OUTCOMES[n]) for n, w in RULE_ORDER)


def python_rule(name: str, weight: int, udf_factory: Callable[[], Column]) -> Rule:
    """Register a rule whose outcome is a ``pandas_udf`` returning ``RESULT_TYPE``."""
    return Rule(name, weight, lambda ctx: udf_factory())


# helper columns projected once before the rules, and the rules that read them
_SHARED_USERS = {
    "_lookalike": ("brand_lookalike",),
    "_reg_age": ("domain_age", "ct_history"),
    "_diff_ratio": ("redirect_and_cloaking",),
}


def shared_columns(rules: RuleSet, as_of: Column, names=None) -> list[Column]:
    """Expressions several rules reuse, projected once before the rules (only those the registry needs)."""
    ctx = RuleContext(rules, as_of)
    exprs = {
        "_lookalike": lambda: lookalike_best(F.col("host"), F.col("registrable"), rules),
        "_reg_age": lambda: _registration_age(ctx),
        "_diff_ratio": diff_ratio_of_pair,
    }
    wanted = set(names) if names is not None else {n for n, _ in RULE_ORDER}
    return [exprs[c]().alias(c) for c, users in _SHARED_USERS.items() if wanted & set(users)]
