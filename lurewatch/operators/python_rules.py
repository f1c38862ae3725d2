"""Rules written in Python, evaluated over Arrow batches (``pandas_udf``, never row-at-a-time).

They read reduced context columns (a host, never a page body) and are
registered like any other rule.

* ``host_entropy_rule``: hosts whose first label looks random (Shannon entropy
  of its characters), which has no built-in form.
* ``idna_punycode_rule``: the punycode test (H09) with Python's IDNA codec,
  exact for arbitrary Unicode hosts where the Column version relies on hosts
  being ASCII after normalisation.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import replace
from encodings import idna

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.operators.heuristics import Rule, python_rule

# result struct as a typed schema (a DDL string would need a session on the workers)
RESULT_STRUCT = T.StructType([T.StructField("scam", T.BooleanType()), T.StructField("benign", T.BooleanType()),
                              T.StructField("suspicious", T.BooleanType()), T.StructField("evidence", T.StringType())])


def _suspicious(hits: pd.Series, evidence: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"scam": False, "benign": False, "suspicious": hits, "evidence": evidence.where(hits, None)})


GUARDED_STRUCT = T.StructType([*RESULT_STRUCT.fields, T.StructField("error", T.StringType())])


def guarded_rule(name: str, weight: int, judge: Callable[[str], tuple[bool, str | None]], attempts: int = 2) -> Rule:
    """A rule that may raise on a host.  ``judge`` gives (suspicious, evidence) of a host.

    A host on which it raises is tried once more; if that fails too, the host
    alone carries the error and its batch goes on.
    """
    def one(host: str | None) -> tuple:
        for _ in range(attempts):
            try:
                hit, evidence = judge(host or "")
                return False, False, bool(hit), evidence if hit else None, None
            except Exception as failure:  # whatever a rule raises belongs to its host
                error = f"{name}: {type(failure).__name__}: {failure}"
        return False, False, False, None, error

    @F.pandas_udf(GUARDED_STRUCT)
    def outcome(host: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(h) for h in host], columns=[f.name for f in GUARDED_STRUCT.fields])

    rule = python_rule(name, weight, lambda: outcome(F.col("host")))
    return replace(rule, can_fail=True)


def label_entropy(host: str | None) -> float:
    """Bits per character of the first label."""
    label = (host or "").partition(".")[0]
    return -sum(n / len(label) * math.log2(n / len(label)) for n in Counter(label).values()) if label else 0.0


def host_entropy_rule(least_bits: float = 3.0, weight: int = 1) -> Rule:
    @F.pandas_udf(RESULT_STRUCT)
    def outcome(host: pd.Series) -> pd.DataFrame:
        bits = pd.Series([label_entropy(h) for h in host], dtype="float64")
        return _suspicious(bits >= least_bits, bits.map("host_entropy={:.2f}".format))

    return python_rule("host_entropy", weight, lambda: outcome(F.col("host")))


def _encoded_labels(host: str) -> list[bytes]:
    """Labels as they would be looked up; as they are if one can't be encoded."""
    labels = [x for x in host.split(".") if x]
    try:
        return [idna.ToASCII(x) for x in labels]
    except UnicodeError:
        return [x.encode() for x in labels]


@F.pandas_udf(RESULT_STRUCT)
def _idna_punycode_udf(host: pd.Series) -> pd.DataFrame:
    hits = pd.Series([any(x.startswith(b"xn--") for x in _encoded_labels(h or "")) for h in host], dtype="bool")
    return _suspicious(hits, pd.Series(["punycode_label_detected"] * len(hits), dtype="object"))


def idna_punycode_rule(weight: int = 2) -> Rule:
    """H09 as a Python rule: replaces ``punycode`` in a registry when hosts may be arbitrary Unicode."""
    return python_rule("punycode", weight, lambda: _idna_punycode_udf(F.col("host")))


@F.pandas_udf(T.StringType())
def _skeleton_udf(text: pd.Series) -> pd.Series:
    from lurewatch.rules import skeleton_py
    return text.map(lambda s: None if s is None else skeleton_py(s))


def skeleton_text(col: Column) -> Column:
    """E5 for arbitrary Unicode text (NFKD, combining marks dropped, confusables mapped), over Arrow batches.

    Normalised hosts use the JVM-side ``functions.hosts.skeleton`` instead.
    """
    return _skeleton_udf(col)
