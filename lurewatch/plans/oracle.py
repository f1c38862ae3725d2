"""DuckDB SQL building blocks for the oracle side of the driver queries.

These restate the operator semantics independently in DuckDB's dialect
(RE2 regexes, list functions, cross joins with ``arg_min``), so a Spark
result can be checked against them.  Only used for verification.
"""

from __future__ import annotations

from lurewatch.rules import RuleSet

# Python str.isspace() characters in RE2 syntax.
WS = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
WORD = "[\\p{L}\\p{N}_]"
IPV4 = "((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


# The driver rule set's derived tables, written out by hand (not computed by the code under test).
OWNED = {0: ("small-ring.com", "small-ring-5.co.uk"), 1: ("red-widget-1.com",), 2: ("hot-gear.com.sg",)}
DEEPEST_SUFFIX = 2
DENSITY_WORDS = ("hot", "hot-gear", "red", "red-widget-1", "small", "small-ring", "small-ring-5")
LOOK_ALIKES = "013@$¡ıɩаеоѕіӏβɡſ"
PLAIN = "oleasiiiaeosilbgs"
# (brand, place, kind, target, skeleton) in evaluation order
TARGETS = ((0, 0, "name", "small ring", "small ring"), (0, 1, "domain", "small-ring", "small-ring"),
           (0, 2, "domain", "small-ring-5", "small-ring-5"), (1, 0, "name", "red widget", "red widget"),
           (1, 1, "domain", "red-widget-1", "red-widget-l"), (2, 0, "name", "hot gear", "hot gear"),
           (2, 1, "domain", "hot-gear", "hot-gear"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def norm_sql(x: str) -> str:
    """normalize_host as one DuckDB expression (lambda-bound steps)."""
    return (
        f"list_transform([lower(regexp_replace(coalesce({x}, ''), '^[{WS}]+|[{WS}]+$', '', 'g'))], lambda s0: "
        "list_transform([CASE WHEN starts_with(s0, '*.') THEN substr(s0, 3) ELSE s0 END], lambda s1: "
        "list_transform([split_part(CASE WHEN contains(s1, '://') THEN split_part(substr(s1, strpos(s1, '://') + 3), '/', 1) "
        "ELSE s1 END, ':', 1)], lambda s3: "
        "CASE WHEN s3 <> '' AND contains(s3, '.') AND regexp_full_match(s3, '(\\*\\.)?[a-z0-9.\\-ıſ]+\\n?') "
        "THEN s3 ELSE '' END)[1])[1])[1]")


def contains_any_sql(x: str, kws, lower_kw: bool = True) -> str:
    ks = [k.strip().lower() if lower_kw else k for k in kws if k]
    ks = [k for k in ks if k]
    if not ks:
        return "false"
    return f"(coalesce({x}, '') <> '' AND list_bool_or(list_transform({arr(ks)}, lambda k: contains(coalesce({x}, ''), k))))"


def brand_sql(x: str, rules: RuleSet, what: str = "name") -> str:
    """First brand (config order) with a match keyword and no exclude keyword, as a CASE chain."""
    parts = []
    for b in sorted(rules.brands, key=lambda b: b.ord):
        m = contains_any_sql(x, rules.brand_match(b))
        e = contains_any_sql(x, rules.brand_exclude(b))
        val = q(b.name) if what == "name" else str(b.ord)
        parts.append(f"WHEN {m} AND NOT {e} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


def suffix_rules_values(rules: RuleSet) -> str:
    return "(VALUES " + ", ".join(f"({q(r)}, {q(k)})" for r, k in rules.suffix_rules) + ") AS sr(rule, kind)"


def registrable_cte(rules: RuleSet, src: str) -> str:
    """CTE body: (host, registrable, suffix) for ``SELECT DISTINCT host FROM src``."""
    k = DEEPEST_SUFFIX
    return f"""
SELECT h.host,
  CASE WHEN regexp_full_match(h.host, '{IPV4}') THEN '' ELSE h.sfx END AS suffix,
  CASE WHEN regexp_full_match(h.host, '{IPV4}') THEN h.host
       WHEN h.reg = '' THEN h.host ELSE h.reg END AS registrable
FROM (
  SELECT g.host, g.sfx,
    concat_ws('.', CASE WHEN g.dom <> '' THEN g.dom END, CASE WHEN g.sfx <> '' THEN g.sfx END) AS reg
  FROM (
    SELECT b.host,
      CASE WHEN b.slen > 0 THEN array_to_string(b.labs[-b.slen:], '.') ELSE '' END AS sfx,
      CASE WHEN len(b.labs) - b.slen >= 1 THEN b.labs[len(b.labs) - b.slen] ELSE '' END AS dom
    FROM (
      SELECT s.host, string_split(s.host, '.') AS labs, coalesce(m.exc, m.best, 0) AS slen
      FROM (SELECT DISTINCT lower(coalesce(host, '')) AS host FROM {src}) s
      LEFT JOIN (
        SELECT c.host,
          max(CASE WHEN sr.kind = 'exception' AND sr.rule = c.cand THEN c.i - 1 END) AS exc,
          max(CASE WHEN (sr.kind = 'exact' AND sr.rule = c.cand) OR (sr.kind = 'wildcard' AND sr.rule = c.parent)
                   THEN c.i END) AS best
        FROM (
          SELECT host, i, array_to_string(string_split(host, '.')[-i:], '.') AS cand,
                 CASE WHEN i > 1 THEN array_to_string(string_split(host, '.')[-(i - 1):], '.') END AS parent
          FROM (SELECT DISTINCT lower(coalesce(host, '')) AS host FROM {src}) d, range(1, {k + 1}) r(i)
          WHERE len(string_split(host, '.')) >= i
        ) c JOIN {suffix_rules_values(rules)} ON sr.rule = c.cand OR sr.rule = c.parent
        GROUP BY c.host
      ) m ON m.host = s.host
    ) b
  ) g
) h"""


def owned_sql(reg: str, rules: RuleSet, brand_ord: int | None = None) -> str:
    regs = sorted({r for o, rs in OWNED.items() if brand_ord is None or o == brand_ord
                   for r in rs})
    if not regs:
        return "false"
    return f"coalesce({reg} IN ({', '.join(q(r) for r in regs)}), false)"


def skeleton_sql(x: str) -> str:
    return f"translate(lower({x}), {q(LOOK_ALIKES)}, {q(PLAIN)})"


def lookalike_targets_values(rules: RuleSet) -> str:
    """(brand_ord, pos, kind, target, skel) rows in evaluation order."""
    return "(VALUES " + ", ".join(f"({o}, {p}, {q(k)}, {q(t)}, {q(s)})" for o, p, k, t, s in TARGETS) + \
        ") AS lt(b_ord, pos, kind, target, skel)"
