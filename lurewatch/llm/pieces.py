"""Documents as sequences of pieces, with the distinct pieces of a group of documents listed once.

Tokenizers work on one piece (a match of the splitting pattern) at a time, so
the costly work is done on the distinct pieces of a group of documents, and
ids of whole documents are gathered from them.  Groups are made inside a
partition: nothing is shuffled, and a group has a bounded number of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def split(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in order (Unicode classes); null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


#: Documents of a batch between Spark and Python: lists of pieces are large.
BATCH_DOCS = 500


def small_batches(spark: SparkSession) -> None:
    """Session setting of the operators on pieces: at most ``BATCH_DOCS`` rows in a batch between Spark and Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCS))


def groups(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Tables of whole documents with up to ``most`` pieces (one longer document is a group of its own)."""
    held, count = [], 0
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = int(np.searchsorted(ends, before + most - count, side="right"))
            if upto <= at and held:
                yield pa.Table.from_batches(held)
                held, count = [], 0
                continue
            upto = max(upto, at + 1)
            held.append(batch.slice(at, upto - at))
            count += int(ends[upto - 1] - before)
            at = upto
    if held:
        yield pa.Table.from_batches(held)


def distinct(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, index of each piece of the documents in order, and pieces of each document."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    coded = lists.flatten().dictionary_encode()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)  # the offsets of a slice span the slice
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False), counts


def gather(index: np.ndarray, counts: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of each document, from the ids of the distinct pieces (``values`` from ``starts``, ``sizes`` many)."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        first = ends[at] - counts[at]
        upto = max(at + 1, int(np.searchsorted(ends, first + 500_000, side="right")))
        part = index[first : ends[upto - 1]]
        n = sizes[part]
        stop = np.cumsum(n)
        ids = values[np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts[part] - (stop - n), n)]
        cuts = np.concatenate([[0], stop])[np.concatenate([[0], ends[at:upto] - first])]
        for i in range(upto - at):
            yield ids[cuts[i] : cuts[i + 1]]
        at = upto
