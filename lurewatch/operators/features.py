"""Page features: every page body reduced to one small struct, map-side.

The rules that read page bodies (H01, H02, H05, H10, H11, H13, H14, H16)
only need booleans, counts, a title and a token set.  Computing them in a
narrow projection right after the scan means the bodies never travel
through a shuffle or a join; ``lower(html)`` and the token array are
projected once and shared by every feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import text as tx
from lurewatch.functions.hosts import normalize_host
from lurewatch.rules import RuleSet
from lurewatch.operators.suffix import registrable_py

FEATURE_FIELDS = ["password", "otp", "card", "cross_post", "exfil", "js_obf", "high_entropy", "wallet",
                  "clipboard", "kit_comment", "parking_sig", "content_token_hit", "words_total",
                  "brand_words", "title_found", "title_text", "title_brands", "token_set", "html_len"]


def density_keywords(rules: RuleSet) -> list[str]:
    """First word of every brand name plus the domain label of every canonical domain."""
    kws = set()
    for b in rules.brands:
        if b.first_word:
            kws.add(b.first_word)
        for d in b.canonical_domains:
            _, dom, _ = registrable_py(d, rules)
            if dom:
                kws.add(dom.lower())
    return sorted(kws)


def cross_domain_post(html: Column, host: Column) -> Column:
    """H01d/C4: a form action with ``://`` whose normalised host is non-empty and differs from ``host``."""
    h = F.coalesce(host, F.lit(""))
    return F.exists(tx.form_actions(html), lambda a: a.contains("://") & (normalize_host(a) != "")
                    & (h != "") & (normalize_host(a) != h) & ~a.startswith("#"))


def with_page_features(df: DataFrame, rules: RuleSet, html_col: str = "html", host_col: str = "host",
                       out: str = "f", judged: Column | None = None, compared: Column | None = None) -> DataFrame:
    """Append struct ``out`` of page features and drop ``html_col``.

    Rows that are not ``judged`` (default: all are) have no features but the
    words and the length; rows that are not even ``compared`` have none at all:
    no pattern runs over their bodies.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    judged = F.lit(True) if judged is None else judged
    body = html if compared is None else F.when(judged | compared, html).otherwise("")
    staged = df.select("*", body.alias("__body"), F.when(judged, html).otherwise("").alias("__html"))
    staged = staged.select("*", F.lower(F.col("__html")).alias("__lower"), tx.title(F.col("__html")).alias("__title"))
    staged = staged.select("*", tx.tokens_of_lowered(F.lower(F.col("__body"))).alias("__words"))
    staged = staged.select("*", tx.folded(F.col("__html")).alias("__folded"))
    h, lo, words, ttl, text = F.col("__html"), F.col("__lower"), F.col("__words"), F.col("__title"), F.col("__folded")
    kws = density_keywords(rules)
    kw_arr = F.array(*[F.lit(k) for k in kws]) if kws else F.array().cast("array<string>")
    title_lower = F.lower(ttl)
    title_brands = F.array_compact(F.array(*[
        F.when(F.lit(bool(b.first_word)) & title_lower.contains(b.first_word), F.lit(b.ord))
        for b in rules.brands])) if rules.brands else F.array().cast("array<int>")
    feats = F.struct(
        tx.holds_any(text, tx.PASSWORD_LITERALS).alias("password"),
        tx.otp_hint(text).alias("otp"),
        tx.holds_any(text, tx.CARD_LITERALS).alias("card"),
        F.when(text.contains("<form"), cross_domain_post(h, F.col(host_col))).otherwise(False).alias("cross_post"),
        tx.holds_any(text, tx.EXFIL_LITERALS).alias("exfil"),
        tx.js_obfuscation(h).alias("js_obf"),
        tx.has_high_entropy_run(h).alias("high_entropy"),
        tx.holds_any(h, tx.WALLET_LITERALS).alias("wallet"),
        (lo.contains("clipboard") & tx.holds_any(h, tx.CLIPBOARD_WRITE_LITERALS)).alias("clipboard"),
        tx.kit_comment(lo).alias("kit_comment"),
        tx.holds_any(lo, rules.parking_signatures).alias("parking_sig"),
        tx.holds_any(lo, rules.content_tokens).alias("content_token_hit"),
        F.size(words).alias("words_total"),
        F.size(F.filter(words, lambda w: F.array_contains(kw_arr, w))).alias("brand_words"),
        tx.title_match(h).alias("title_found"),
        ttl.alias("title_text"),
        title_brands.alias("title_brands"),
        F.array_distinct(words).alias("token_set"),
        F.length(F.col("__body")).alias("html_len"),
    )
    keep = [c for c in df.columns if c != html_col]
    return staged.select(*keep, feats.alias(out))
