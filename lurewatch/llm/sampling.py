"""Bounded samples that need no sort and no more than the sample on any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """All rows if there are at most ``most``, else those whose hash lies below a share that leaves about nine tenths of it, and never more than ``most``.

    The hash is that of ``columns`` and of the row's place in its partition, so
    rows that share an id, or are equal, are in or out one by one.  The same
    rows on every run over the same files.
    """
    n = rows.count()
    if n <= most:
        return rows
    draw = F.pmod(F.xxhash64(F.lit("sample"), *columns, F.monotonically_increasing_id()), F.lit(1 << 30))
    return rows.filter(draw < int((1 << 30) * 0.9 * most / n)).limit(most)
