"""Training corpus pipeline: quality rules, line dedup, near dedup, mixing, encoding.

``STAGES`` lists (name, function).  A function takes (spark, docs, sf_dir) and
returns the documents it leaves, in the columns it got; the last one returns
the encoded documents.  ``run`` writes each stage's result to the shared folder
and reads it back for the next one.

Joins with the documents sort and merge at every size.

A document is an id and a text: rows that share an id but not the text are
documents each.

Columns other than doc_id, text, source and n_chars pass through untouched.
Stages keep the rows of an empty table at none, and treat null texts as empty
(the first stage rejects them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm import bpe, line_dedup, mixing, near_dup, quality_rules
from lurewatch.llm.scratch import Scratch


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and whole rows in one column that no operator's results can clash with."""
    return docs.select(*needed, F.struct(*docs.columns).alias("_row"))


def _unpacked(rows: DataFrame, like: DataFrame, **changed) -> DataFrame:
    return rows.select(*[(changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    judged = quality_rules.score(_packed(docs, "text"), ["_row"])
    return _unpacked(judged.filter("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that consists of them alone goes.  n_chars follows the text."""
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text")))
    cut = line_dedup.dedup_lines(_packed(docs, "doc_id", "text").withColumn("doc_id", key))
    left = cut.filter((F.col("n_dropped") == 0) | F.col("text").rlike(quality_rules.NOT_SPACE))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None
    return _unpacked(left, docs, text=F.col("text"), n_chars=n_chars)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of least id (and of those that share it, of least hash of the text).

    Repeated rows leave the one whose JSON is least; rows without an id stay.
    """
    scratch = Scratch(spark, "near-stage")
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.select(key.alias("_key"), "doc_id", "text").filter(F.col("_key").isNotNull())
    found = near_dup.classes(keyed, id_col="_key").groupBy(F.col("doc_id").alias("_key")).agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    ids = keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"))
    named = found.join(ids.hint("merge"), "_key")
    least = named.groupBy("class_id").agg(F.min(F.struct("doc_id", "_key", "_n")).alias("x"))
    kept = scratch.write(least.select(F.col("x._key").alias("_kept"), "x._n"))
    joined = _packed(docs, "doc_id", "text").withColumn("_key", key).join(kept.hint("merge"), F.col("_key") == F.col("_kept"))
    once = joined.filter(F.col("_n") == 1).select("_row")
    repeated = joined.filter(F.col("_n") > 1).groupBy("_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    nameless = _packed(docs.filter(F.col("doc_id").isNull())).select("_row")
    return _unpacked(once.unionByName(repeated).unionByName(nameless), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    key = F.xxhash64("text")
    taken = mixing.mix(docs.select("doc_id", "text", "source", key.alias("_key_of")), extra=("_key_of",))
    copies = Scratch(spark, "mix-stage").write(taken.groupBy(F.col("doc_id").alias("_id"), "_key_of").agg(F.max("copies").alias("_copies")).filter("_copies > 0"))
    rows = _packed(docs, "doc_id", "text").withColumn("_key", key)
    joined = rows.join(copies.hint("merge"), rows["doc_id"].eqNullSafe(copies["_id"]) & (rows["_key"] == copies["_key_of"]))
    return _unpacked(joined.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"))
    both = bpe.encode(rows, path, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("_digest")).alias("round_trip"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("encoding", encode)]

#: The posterior of the rules and the ranked merges aren't for SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch.write(docs)
    return docs
