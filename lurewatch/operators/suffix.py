"""Registrable domain and public suffix (B10-B12) as a broadcast equi-join.

The suffix rules (exact / wildcard / exception) form a small dimension keyed by
the rule text.  For every host the last ``i`` labels (``i = 1..K``, ``K`` = the
deepest rule) are looked up with one broadcast hash join per depth; the joins
are map-side, so the whole operator adds no shuffle and keeps the host table's
partitioning.  Precedence: an exception rule wins; otherwise the longest match;
an unknown TLD gives suffix '' and the last label as the domain; an IP address
is its own registrable domain.

``registrable_py`` applies the same rules to the (small, driver-side) brand
configuration only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.rules import RuleSet

# A rule dimension this small is always broadcast; beyond it the planner decides.
BROADCAST_MAX_RULES = 200_000

IPV4_RE = "^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"

_LOOKUP_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("exact", T.BooleanType(), False),
    T.StructField("wildcard", T.BooleanType(), False),
    T.StructField("exception", T.BooleanType(), False),
])


def _lookup_rows(rules: RuleSet) -> list[tuple[str, bool, bool, bool]]:
    flags: dict[str, list[bool]] = {}
    for rule, kind in rules.suffix_rules:
        f = flags.setdefault(rule.lower(), [False, False, False])
        f[("exact", "wildcard", "exception").index(kind)] = True
    return [(k, *v) for k, v in sorted(flags.items())]


def max_depth(rules: RuleSet) -> int:
    depth = 1
    for rule, kind in rules.suffix_rules:
        n = rule.count(".") + 1
        depth = max(depth, n + 1 if kind == "wildcard" else n)
    return depth


def suffix_dimension(spark: SparkSession, rules: RuleSet) -> DataFrame:
    rows = _lookup_rows(rules)
    df = spark.createDataFrame(rows, _LOOKUP_SCHEMA)
    return F.broadcast(df) if len(rows) <= BROADCAST_MAX_RULES else df


def with_registrable(df: DataFrame, rules: RuleSet, host_col: str = "host",
                     out_registrable: str = "registrable", out_suffix: str = "suffix") -> DataFrame:
    """Append ``registrable`` (eTLD+1) and ``suffix`` columns for ``host_col``."""
    spark = df.sparkSession
    dim = suffix_dimension(spark, rules)
    k_max = max_depth(rules)
    h = F.lower(F.coalesce(F.col(host_col), F.lit("")))
    out = df.select("*", F.split(h, "\\.").alias("__labels"))
    out = out.select("*", F.size("__labels").alias("__n"))
    out = out.select("*", *[F.when(F.col("__n") >= i, F.array_join(F.slice("__labels", -i, i), ".")).alias(f"__c{i}")
                            for i in range(1, k_max + 1)])
    for i in range(1, k_max + 1):
        d = dim.select(F.col("key").alias(f"__k{i}"), F.col("exact").alias(f"__e{i}"),
                       F.col("wildcard").alias(f"__w{i}"), F.col("exception").alias(f"__x{i}"))
        out = out.join(d, F.col(f"__c{i}") == F.col(f"__k{i}"), "left")
    # length (in labels) of the public suffix chosen at each depth
    exc_len: Column = F.lit(None).cast("int")
    best: Column = F.lit(0)
    for i in range(1, k_max + 1):
        exc_len = F.when(F.coalesce(F.col(f"__x{i}"), F.lit(False)), F.lit(i - 1)).otherwise(exc_len)
        hit = F.coalesce(F.col(f"__e{i}"), F.lit(False))
        if i > 1:
            hit = hit | F.coalesce(F.col(f"__w{i - 1}"), F.lit(False))
        best = F.when(hit & (F.col("__n") >= i), F.lit(i)).otherwise(best)
    slen = F.coalesce(exc_len, best)
    is_ip = h.rlike(IPV4_RE)
    suffix = F.when(slen > 0, F.array_join(F.slice("__labels", -slen, slen), ".")).otherwise(F.lit(""))
    dom_pos = F.col("__n") - slen
    domain = F.when(dom_pos >= 1, F.get(F.col("__labels"), dom_pos - 1)).otherwise(F.lit(""))
    reg = F.concat_ws(".", F.when(domain != "", domain), F.when(suffix != "", suffix))
    reg = F.when(reg == "", h).otherwise(reg)
    out = out.select("*", slen.alias("__slen"))
    keep = [c for c in df.columns if c not in (out_suffix, out_registrable)]
    return out.select(*keep, F.when(is_ip, F.lit("")).otherwise(suffix).alias(out_suffix),
                      F.when(is_ip, h).otherwise(reg).alias(out_registrable))


def registrable_py(host: str, rules: RuleSet) -> tuple[str, str, str]:
    """(registrable, domain, suffix) of a configuration host, same rules as above."""
    h = host.lower()
    if re.match(IPV4_RE, h):
        return h, h, ""
    labs = h.split(".")
    n = len(labs)
    exact = {r for r, k in rules.suffix_rules if k == "exact"}
    wild = {r for r, k in rules.suffix_rules if k == "wildcard"}
    exc = {r for r, k in rules.suffix_rules if k == "exception"}
    slen, exc_len = 0, None
    for i in range(1, min(n, max_depth(rules)) + 1):
        cand = ".".join(labs[-i:])
        if cand in exc:
            exc_len = i - 1
        if cand in exact or (i > 1 and ".".join(labs[-(i - 1):]) in wild):
            slen = i
    if exc_len is not None:
        slen = exc_len
    suffix = ".".join(labs[n - slen:]) if slen else ""
    domain = labs[n - slen - 1] if n - slen >= 1 else ""
    reg = ".".join(p for p in (domain, suffix) if p) or h
    return reg, domain, suffix


def brand_registrables(rules: RuleSet) -> dict[int, tuple[str, ...]]:
    """Registrable domains of each brand's canonical domains (config-sized)."""
    return {b.ord: tuple(registrable_py(d, rules)[0] for d in b.canonical_domains) for b in rules.brands}


def owned_by_brand(registrable: Column, rules: RuleSet, brand_ord: int | None = None) -> Column:
    """``registrable`` equals the registrable domain of a canonical domain (of one brand, or any)."""
    regs = brand_registrables(rules)
    vals = sorted({r for o, rs in regs.items() if brand_ord is None or o == brand_ord for r in rs})
    if not vals:
        return F.lit(False)
    return F.coalesce(registrable.isin(vals), F.lit(False))


def with_owner(df: DataFrame, rules: RuleSet, registrable_col: str = "registrable") -> DataFrame:
    """Append ``owner`` (first brand, in configuration order, whose canonical domains share the registrable)."""
    owner = F.coalesce(*[F.when(owned_by_brand(F.col(registrable_col), rules, b.ord), F.lit(b.name))
                         for b in rules.brands], F.lit(None).cast("string"))
    return df.withColumn("owner", owner)
