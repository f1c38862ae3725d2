"""Brand attribution and gates.

The brand list is configuration, so attribution is a per-row expression: no
join, no shuffle.  Keywords are looked up through an index of n-grams, a literal
hash table: each keyword stands under its first three characters (or all, if it
has fewer), the n-grams of a host name the few keywords that may occur in it, and
only these are compared.  So the time for a host follows its length and not the
number of brands, and the plan is the same for three brands or five thousand.
The first brand in configuration order wins, and an exclusion in one brand never
blocks a later one.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.hosts import contains_any
from lurewatch.rules import RuleSet

#: Characters of an indexed n-gram at most.
GRAM = 3


def _bound(value: Column, body) -> Column:
    """Evaluates ``value`` once: inside a lambda a plain reference would be evaluated for every use."""
    return F.get(F.transform(F.array(value), body), 0)


def _index(words: dict[str, list[int]]) -> tuple[Column, int, list[int]]:
    """Hash table of (word, ords) by n-gram, its size, and the lengths of n-grams in use."""
    size = 1
    while size < 2 * len(words):
        size *= 2
    table: list[list[dict]] = [[] for _ in range(size)]
    for word, ords in words.items():
        table[zlib.crc32(word[:GRAM].encode()) % size].append({"word": word, "ords": ords})
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<word:string,ords:array<int>>>>"), size, sorted({min(GRAM, len(w)) for w in words})


def _occurring(host: Column, words: dict[str, list[int]]) -> Column:
    """Ords whose words occur in the host."""
    table, size, lengths = _index(words)
    none = F.array().cast("array<int>")
    no_grams = F.array().cast("array<string>")

    def grams_of(n: int) -> Column:
        return F.when(F.length(host) >= n, F.transform(F.sequence(F.lit(1), F.length(host) - (n - 1)), lambda i: F.substring(host, i, F.lit(n)))).otherwise(no_grams)

    grams = F.array_distinct(F.concat(*map(grams_of, lengths))) if lengths else no_grams
    found = F.flatten(F.transform(grams, lambda g: F.filter(F.get(table, (F.crc32(g) % size).cast("int")), lambda e: host.contains(e["word"]))))
    return F.array_distinct(F.flatten(F.transform(found, lambda e: e["ords"]))) if words else none


def _first_brand(host: Column, rules: RuleSet) -> Column:
    """Struct of the first brand that has a match keyword in the host and no exclude keyword."""
    match: dict[str, list[int]] = {}
    exclude: dict[str, list[int]] = {}
    for at, b in enumerate(rules.brands):
        for words, into in ((rules.brand_match(b), match), (rules.brand_exclude(b), exclude)):
            for word in dict.fromkeys(words):
                into.setdefault(word, []).append(at)
    table = F.from_json(F.lit(json.dumps([{"ord": b.ord, "name": b.name} for b in rules.brands])), "array<struct<ord:int,name:string>>")

    def first(h: Column) -> Column:
        return F.get(table, F.array_min(F.array_except(_occurring(h, match), _occurring(h, exclude))))

    return _bound(F.coalesce(host, F.lit("")), first)


def brand_ord_of(host: Column, rules: RuleSet) -> Column:
    return _first_brand(host, rules)["ord"]


def brand_of(host: Column, rules: RuleSet) -> Column:
    return _first_brand(host, rules)["name"]


def match_brand(df: DataFrame, rules: RuleSet, host_col: str = "host") -> DataFrame:
    """Append ``brand`` and ``brand_ord`` (null = irrelevant)."""
    h = F.col(host_col)
    return df.withColumn("brand", brand_of(h, rules)).withColumn("brand_ord", brand_ord_of(h, rules))


def relevant(df: DataFrame, rules: RuleSet, host_col: str = "host") -> DataFrame:
    return df.where(brand_of(F.col(host_col), rules).isNotNull())


def irrelevant(df: DataFrame, rules: RuleSet, host_col: str = "host") -> DataFrame:
    return df.where(brand_of(F.col(host_col), rules).isNull())


def is_trusted(host: Column, rules: RuleSet) -> Column:
    """A trusted substring (lower-cased, not stripped) occurs in lower(host)."""
    return contains_any(F.lower(host), rules.trusted_l, normalise=False)


def is_auto_scam(host: Column, rules: RuleSet) -> Column:
    return contains_any(F.lower(host), rules.auto_scam_l, normalise=False)


def gate(host: Column, rules: RuleSet) -> Column:
    """'dropped' (trusted, checked first), 'scam' (auto-scam) or null (go on to the rules)."""
    return (F.when(is_trusted(host, rules), F.lit("dropped"))
             .when(is_auto_scam(host, rules), F.lit("scam")))


def filter_counts(hosts: DataFrame, rules: RuleSet, host_col: str = "host") -> DataFrame:
    """Relevant / irrelevant host counts of a batch (one global partial aggregate)."""
    b = brand_of(F.col(host_col), rules)
    return hosts.agg(F.count_if(b.isNotNull()).alias("relevant"), F.count_if(b.isNull()).alias("irrelevant"))
