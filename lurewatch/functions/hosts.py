"""Host-name Column functions.

B2 (an empty normalised host is dropped) is the ``where(host != '')`` every
reader and ``plans.triage.triage`` apply right after ``normalize_host``.

Everything here is a pure Column expression built from ``pyspark.sql.functions``
so it stays JVM-side, composes inside higher-order lambdas and never forces a
Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.rules import CONFUSABLES

# Python ``str.isspace`` characters, spelled out (Java ``\s`` is ASCII only).
WS_CLASS = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
STRIP_RE = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"

# After lower-casing, the ignore-case class [a-z0-9.-] also admits the dotless i
# and the long s; the pattern is anchored and uses UNIX_LINES so ``$`` behaves
# like Python's (end, or before one final newline).
HOST_RE = "(?d)^(?:\\*\\.)?[a-z0-9.\\-ıſ]+$"
# HOST_RE plus "contains a dot", capturing the whole input (with the one final newline ``$`` admits)
HOST_EXTRACT_RE = "(?d)^((?=[^\\n]*\\.)(?:\\*\\.)?[a-z0-9.\\-ıſ]+\\n?)$"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace), unlike Spark ``trim``."""
    return F.regexp_replace(c, STRIP_RE, "")


def normalize_host(c: Column) -> Column:
    """Bare lower-case host from a URL / wildcard / host:port string, '' if invalid."""
    # each step reads the previous one once, so the expression stays linear (codegen-friendly)
    s = F.lower(strip_ws(F.coalesce(c, F.lit(""))))
    s = F.regexp_replace(s, "^\\*\\.", "")                      # one leading '*.'
    s = F.regexp_replace(s, "(?s)^.*?://([^/]*).*$", "$1")         # after the first '://', up to '/'
    s = F.substring_index(s, ":", 1)
    # non-empty, has a dot, allowed characters only: the whole string, else '' (no match)
    return F.regexp_extract(s, HOST_EXTRACT_RE, 1)


def contains_any(c: Column, keywords: Iterable[str], normalise: bool = True) -> Column:
    """True when a (stripped, lower-cased, non-empty) keyword is a substring of ``c``.

    False when ``c`` is null/empty or no usable keyword exists.  The list
    becomes one regex alternation of escaped literals (codegen, text read once).
    """
    kws = [k.strip().lower() if normalise else k for k in keywords if k is not None]
    kws = [k for k in kws if k]
    if not kws:
        return F.lit(False)
    text = F.coalesce(c, F.lit(""))
    # one find() over an alternation of escaped literals: the text is referenced once,
    # so the expression stays small when the optimizer inlines ``c``
    return text.rlike("|".join(regex_literal(k) for k in kws))


def regex_literal(s: str) -> str:
    """Escape a literal for a Java regex (every non-alphanumeric character backslash-escaped)."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in s)


def first_hit(items: Column, needles: Iterable[str]) -> Column:
    """First element of an array (in order) containing any needle (lower-cased)."""
    ns = [n.lower() for n in needles if n]
    if not ns:
        return F.lit(None).cast("string")
    return F.get(F.filter(items, lambda t: contains_any(F.lower(t), ns, normalise=False)), 0)


def labels(c: Column) -> Column:
    return F.split(c, "\\.")


def label_count(c: Column) -> Column:
    """Number of non-empty dot-separated labels."""
    return F.size(F.filter(labels(F.coalesce(c, F.lit(""))), lambda x: x != ""))


def first_label(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


# Parameters of the punycode form of Bootstring (fixed values)
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_POINT = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# no label of a host name is longer, which bounds every number below and so the folds' steps
LABEL_MAX = 63
LONGEST_NUMBER, MOST_DIVISIONS = 12, 8


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _digits(number: Column, bias: Column) -> Column:
    """``number`` as a variable-length integer: the digits' thresholds follow from the bias."""
    def step(state: Column, place: Column) -> Column:
        limit = F.least(F.greatest(place * BASE - bias, F.lit(T_MIN)), F.lit(T_MAX)).cast("long")

        def put(t: Column) -> Column:
            more = state["rest"] >= t
            digit = F.when(more, t + (state["rest"] - t) % (BASE - t)).otherwise(state["rest"])
            rest = F.when(more, F.floor((state["rest"] - t) / (BASE - t))).otherwise(F.lit(-1).cast("long"))
            return F.struct(F.concat(state["text"], F.substring(F.lit(DIGITS), digit.cast("int") + 1, F.lit(1))).alias("text"), rest.alias("rest"))
        return F.when(state["rest"] < 0, state).otherwise(_let(limit, put))

    start = F.struct(F.lit("").alias("text"), number.cast("long").alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST_NUMBER)), start, step, lambda x: x["text"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """Bias after a number: high where numbers were large."""
    most = (BASE - T_MIN) * T_MAX // 2
    halved = F.floor(delta / F.when(first, DAMP).otherwise(2))
    start = F.struct(_let(halved, lambda d: d + F.floor(d / points)).alias("d"), F.lit(0).cast("long").alias("k"))

    def step(x: Column, _: Column) -> Column:
        smaller = F.struct(F.floor(x["d"] / (BASE - T_MIN)).alias("d"), (x["k"] + BASE).alias("k"))
        return F.when(x["d"] > most, smaller).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIVISIONS)), start, step,
                       lambda x: x["k"] + F.floor((BASE - T_MIN + 1) * x["d"] / (x["d"] + SKEW)))


def punycode_label(label: Column) -> Column:
    """Punycode of a label (without ``xn--``): Bootstring as a fold over its non-ASCII code points.

    The code points are inserted in order of value and place; each is written as
    the distance, in (code point, place) counted over the growing text, from the
    insertion before it.  For labels of at most ``LABEL_MAX`` code points.
    """
    def encode(points: Column) -> Column:
        basic = F.filter(points, lambda p: p["point"] < FIRST_POINT)
        inserted = F.array_sort(F.filter(points, lambda p: p["point"] >= FIRST_POINT))
        text = F.concat(F.array_join(F.transform(basic, lambda p: p["char"]), ""), F.when(F.size(basic) > 0, "-").otherwise(""))
        start = F.struct(text.alias("text"), F.lit(FIRST_BIAS).cast("long").alias("bias"), F.lit(FIRST_POINT).cast("long").alias("point"),
                         F.lit(0).cast("long").alias("at"), F.size(basic).cast("long").alias("n"), F.lit(True).alias("first"))

        def step(s: Column, p: Column) -> Column:
            # characters already written that stand before this one
            before = F.size(F.filter(points, lambda q: (q["place"] < p["place"]) & (q["point"] <= p["point"]))).cast("long")
            delta = (p["point"] - s["point"]) * (s["n"] + 1) + before - s["at"]
            return _let(delta, lambda d: F.struct(
                F.concat(s["text"], _digits(d, s["bias"])).alias("text"), _adapted(d, s["n"] + 1, s["first"]).alias("bias"),
                p["point"].alias("point"), (before + 1).alias("at"), (s["n"] + 1).alias("n"), F.lit(False).alias("first")))

        return F.aggregate(inserted, start, step, lambda s: s["text"])

    chars = F.filter(F.split(label, ""), lambda c: c != "")
    return _let(F.transform(chars, lambda c, i: F.struct(F.ascii(c).cast("long").alias("point"), i.alias("place"), c.alias("char"))), encode)


def idna_host(host: Column) -> Column:
    """The IDNA form of a normalised host (ASCII plus U+0131/U+017F), or the host itself where it has none.

    The long s is mapped to s; a label that keeps a dotless i becomes ``xn--``
    and its punycode.  A host with a label that is empty (other than after a
    final dot), too long, or both non-ASCII and already ``xn--`` has no IDNA form.
    """
    def whole(parts: Column) -> Column:
        def one(label: Column) -> Column:
            coded = F.when(label.contains("ı"), F.when(~label.startswith("xn--") & (F.length(label) <= LABEL_MAX), F.concat(F.lit("xn--"), punycode_label(label)))).otherwise(label)
            return _let(coded, lambda x: F.when((F.length(x) >= 1) & (F.length(x) <= LABEL_MAX), x))
        ending = F.when(F.element_at(parts, -1) == "", ".").otherwise("")
        named = F.when(ending == ".", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
        return _let(F.transform(named, one), lambda done: F.when(~F.exists(done, lambda x: x.isNull()), F.concat(F.array_join(done, "."), ending)))

    plain = F.translate(host, "ſ", "s")
    return F.when(host.rlike("[ıſ]"), F.coalesce(_let(labels(plain), whole), host)).otherwise(host)


def is_punycode(host: Column) -> Column:
    """The IDNA form starts with ``xn--`` or has an ``xn--`` label."""
    return _let(idna_host(F.coalesce(host, F.lit(""))), lambda h: h.startswith("xn--") | h.contains(".xn--"))


def skeleton(c: Column) -> Column:
    """Confusable skeleton for host-like text (ASCII + U+0131/U+017F).

    NFKD of the long s is ``s``; other compatibility decompositions cannot occur
    in normalised hosts.  Arbitrary Unicode text uses ``rules.skeleton_py`` on
    the (small) brand dimension.
    """
    src = "".join(CONFUSABLES.keys()) + "ſ"
    dst = "".join(CONFUSABLES.values()) + "s"
    return F.translate(F.lower(c), src, dst)


def confusable_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Levenshtein distance of the skeletons; null above ``limit`` when given."""
    if limit is None:
        return F.levenshtein(skeleton(a), skeleton(b))
    d = F.levenshtein(skeleton(a), skeleton(b), limit)
    return F.when(d >= 0, d)
