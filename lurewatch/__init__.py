"""lurewatch: brand-impersonation triage of web hosts on Apache Spark.

Hosts arrive from feeds (batch files or Structured Streaming), are normalised
and deduplicated, attributed to a brand, joined with captured page / DNS /
TLS / registration / favicon / CNAME / certificate-history records, scored by
25 ordered weighted rules written as Column expressions, and written out with
a verdict.  See README.md for the module map.
"""

from lurewatch.rules import Brand, RuleSet, Thresholds  # noqa: F401

__all__ = ["Brand", "RuleSet", "Thresholds"]
