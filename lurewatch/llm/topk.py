"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row: its dimensions are the terms, its components the
weights.  Queries are packed into blocks of bounded size and every block meets
every slice of the candidates; inside such a pair each term's posting list (the
non-zero weights of the slice in that dimension) is scattered, times the query
weights, into a dense array of scores.  The best ``k`` of each query and slice
are selected by partition, and a window merges the slices.

Memory of a task: one slice, one query block and a dense score array of
``QUERY_BLOCK * CHUNK`` numbers, whatever the size of the tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query block and of a candidate slice (targets; both are dealt by hash), and candidates scored at once.
QUERY_BLOCK, SLICE, CHUNK = 1024, 16384, 2048


def integer_components(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(rows: pd.Series) -> np.ndarray:
    """Rows of integers as a matrix; shorter rows have no weight in the missing terms."""
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores (queries x candidates): each term scatters its postings, scaled by the queries' weights."""
    terms = min(queries.shape[1], candidates.shape[1])
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(terms, 1)
    kind = np.float64 if bound < 2**53 else np.int64  # doubles are exact up to 2**53
    scores = np.zeros((len(queries), len(candidates)), dtype=kind)
    for t in range(terms):
        having = np.flatnonzero(queries[:, t])
        postings = np.flatnonzero(candidates[:, t])
        if not len(having) or not len(postings):
            continue
        q, c = queries[having, t].astype(kind), candidates[postings, t].astype(kind)
        if len(having) == len(queries) and len(postings) == len(candidates):
            scores += q[:, None] * c[None, :]
        else:
            scores[np.ix_(having, postings)] += q[:, None] * c[None, :]
    return scores.astype(np.int64)


def _select(query_ids, ids, scores, k: int):
    """Best ``k`` of each row without the query's own id; candidates come in ascending id order, so a stable sort breaks ties."""
    for i, own in enumerate(query_ids):
        row = scores[i]
        keep = np.flatnonzero(ids != own)
        if len(keep) > k:
            values = row[keep]
            least = np.partition(values, len(values) - k)[len(values) - k]
            above = keep[values > least]
            keep = np.sort(np.concatenate([above, keep[values == least][: k - len(above)]]))
        keep = keep[np.argsort(-row[keep], kind="stable")]
        yield own, ids[keep], row[keep]


def best_of_slice(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top ``k`` of one slice for one block of queries."""
    if not len(candidates) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    candidates = candidates.sort_values("vec_id", kind="stable")
    q, query_ids = _matrix(queries["_weights"]), queries["vec_id"].to_numpy()
    best = [[] for _ in query_ids]
    for at in range(0, len(candidates), CHUNK):
        part = candidates.iloc[at : at + CHUNK]
        scores = accumulate(q, _matrix(part["_weights"]))
        for i, (_, ids, values) in enumerate(_select(query_ids, part["vec_id"].to_numpy(), scores, k)):
            best[i].append((ids, values))
    out = []
    for own, parts in zip(query_ids, best):
        ids, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, -values))[:k]
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[order], "score": values[order]}))
    return pd.concat(out, ignore_index=True)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` candidates with the highest inner product of each query: query_id, rank, vec_id, score.

    Vectors that are null or hold a null or non-finite component, and rows
    without an id, take no part.  Empty vectors score 0 with everything.
    Vectors of unequal length: a missing component weighs nothing.  Rows with
    the query's own id are no candidates for it; repeated rows are candidates
    each.  Ties go to the smaller id.  Other columns are ignored.  An empty
    table gives no rows.
    """
    # the hash that deals rows also covers the vector, so copies of one id spread
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), integer_components(F.col(vector_col)).alias("_weights"),
        F.coalesce(is_query, F.lit(False)).alias("_query"), F.xxhash64(F.col(id_col), F.col(vector_col)).alias("_deal"))
    size = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("_query"), 1))).first()
    slices, blocks = max(1, -(-size[0] // SLICE)), max(1, -(-size[1] // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "_weights", F.pmod("_deal", F.lit(slices)).cast("int").alias("_slice"), every(blocks).alias("_block"))
    queries = rows.filter("_query").select("vec_id", "_weights", F.pmod(F.shiftright("_deal", 8), F.lit(blocks)).cast("int").alias("_block"), every(slices).alias("_slice"))
    pairs = candidates.groupBy("_slice", "_block").cogroup(queries.groupBy("_slice", "_block"))
    best = pairs.applyInPandas(lambda c, q: best_of_slice(c, q, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """Five nearest rows of every ``embeddings`` row whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, coalesce(score, 0) AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
