"""Near-duplicate documents by BagMinHash over word shingles.

1. Texts of the same words are one class from the start; the least id stands for it.
2. Each text gets a BagMinHash signature of its multiset of 5-word shingles; bands of it deal texts into buckets.
3. In a bucket, every member is compared with the first one by its whole
   shingle multiset (similarity 0.8 or more is a link), and where that doesn't
   join the whole bucket into one component, with the next few.  Pairs inside
   a component add nothing and are never made, so a large group of near copies
   costs its size, not its square.
   What is left over (members outside their bucket's largest component) meets
   the whole bucket in blocks of bounded size: a task multiplies two blocks'
   incidence matrices and hands on one link for each two components.
4. The components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm import bagminhash as bag
from lurewatch.llm.components import label
from lurewatch.llm.scratch import Scratch

#: Words of a shingle, least similarity, bands and registers of a band.
WIDTH, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 6
#: Least share of equal registers of a pair that is verified: four standard deviations below ``SIMILAR``.
PROMISING = SIMILAR - 4 * (SIMILAR * (1 - SIMILAR) / (BANDS * ROWS)) ** 0.5
#: First members of a bucket that the others are compared with, and members of a block of what is left over.
LEADS, BLOCK = 8, 200
#: Documents whose signatures are made at once hold about so many shingles.
AT_ONCE = 400_000
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashed = batch.column("hashes")
        flat = hashed.flatten().to_numpy(zero_copy_only=False)
        counts = np.diff(hashed.offsets.to_numpy()).astype(np.int64)
        ends = np.cumsum(counts)
        at = 0
        while at < len(counts):
            first = ends[at] - counts[at]
            upto = max(at + 1, int(np.searchsorted(ends, first + AT_ONCE, side="right")))
            doc, element, weight = bag.weigh(*bag.shingles(flat[first : ends[upto - 1]], counts[at:upto], WIDTH))
            signature = bag.signatures(doc, element, weight, upto - at, BANDS * ROWS)
            found = bag.bands(signature, ROWS).view(np.int64)
            short = (bag.mix(signature.view(np.uint64)) >> np.uint64(48)).astype("<u2")
            filled = counts[at:upto] > 0
            offsets = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[filled].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, upto - at), batch.column("key").slice(at, upto - at), lists, pa.array([x.tobytes() for x in short], pa.binary())], names=["id", "key", "bands", "short"])
            at = upto


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def multiset(value):
        w = value.values.to_numpy(zero_copy_only=False)
        return bag.shingles(w, np.array([len(w)]), WIDTH)[0]

    for batch in batches:
        a, b, left, right = (batch.column(c) for c in ("a", "b", "left", "right"))
        keep, last, held = [], None, None
        for i in range(batch.num_rows):
            if (node := a[i].as_py()) != last:
                last, held = node, multiset(left[i])
            least, most = bag.overlap(held, multiset(right[i]))
            if least >= SIMILAR * most:
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in enough registers."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(batch.num_rows, BANDS * ROWS) for c in ("x", "y"))
        at = pa.array(np.flatnonzero((left == right).mean(axis=1) >= PROMISING))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough.

    Signatures rule out most pairs before a text moves.  The joins sort and
    merge at every size, so that the work on small tables foretells large ones.
    """
    def both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        one = pairs.join(table.select(F.col(table.columns[0]).alias("a"), F.col(column).alias("x")).hint("merge"), "a")
        return one.join(table.select(F.col(table.columns[0]).alias("b"), F.col(column).alias("y")).hint("merge"), "b")

    likely = scratch.write(both(pairs.distinct(), reps.select("rep", "short"), "short").select("a", "b", "x", "y").mapInArrow(_promising, "a long, b long"))
    hashed = both(likely, texts, "text").select("a", "b", _hashes(words(F.col("x"))).alias("left"), _hashes(words(F.col("y"))).alias("right"))
    found = scratch.write(hashed.mapInArrow(_verify, "a long, b long"))
    scratch.drop(likely)
    return found


def _unjoined(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, id, label) of the buckets whose members are in several components."""
    placed = scratch.write(members.join(labels, members["id"] == labels["node"], "left").select("bucket", "id", F.coalesce("label", "id").alias("label")))
    several = scratch.write(placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("bucket"))
    return scratch.write(placed.join(several, "bucket"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's multiset as a set: the k-th occurrence of a shingle is an element of its own."""
    for batch in batches:
        out = []
        for value in batch.column("hashes"):
            w = value.values.to_numpy(zero_copy_only=False)
            kind, n = np.unique(bag.shingles(w, np.array([len(w)]), WIDTH)[0], return_counts=True)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(bag.mix(np.repeat(kind, n) ^ bag.mix(place.astype(np.uint64))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "elements"])


def _compare(rows):
    """One link for each two components that a similar pair of the two blocks joins."""
    import pandas as pd
    sides = [rows[rows["side"] == k].drop_duplicates("id") for k in (0, 1)]
    sets = [[np.frombuffer(x, dtype=np.uint64) for x in side["elements"]] for side in sides]
    sizes = [np.array([len(x) for x in s]) for s in sets]
    flat = np.concatenate([x for s in sets for x in s])
    kind, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1  # an element of one text adds to no overlap
    column = np.where(n[at] > 1, shared[at], -1)
    row = np.repeat(np.arange(len(sets[0]) + len(sets[1])), np.concatenate(sizes))
    both = np.zeros((len(sets[0]), len(sets[1])), dtype=np.float32)
    for start in range(0, int(shared[-1]) + 1 if len(shared) else 0, 8192):
        here = (column >= start) & (column < start + 8192)
        matrix = np.zeros((len(sets[0]) + len(sets[1]), 8192), dtype=np.float32)
        matrix[row[here], column[here] - start] = 1
        both += matrix[: len(sets[0])] @ matrix[len(sets[0]) :].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    labels = [side["label"].to_numpy() for side in sides]
    i, j = np.nonzero((both >= SIMILAR * union) & (labels[0][:, None] != labels[1][None, :]))
    pairs = pd.DataFrame({"a": sides[0]["id"].to_numpy()[i], "b": sides[1]["id"].to_numpy()[j], "x": np.minimum(labels[0][i], labels[1][j]), "y": np.maximum(labels[0][i], labels[1][j])})
    return pairs.drop_duplicates(["x", "y"])[["a", "b"]]


def _by_blocks(left: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between different components of a bucket, from comparing those outside its largest one with all."""
    sizes = left.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = scratch.write(sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most")))
    hashed = texts.join(left.select("id").distinct(), "id", "left_semi").select("id", _hashes(words(F.col("text"))).alias("hashes"))
    elements = scratch.write(hashed.mapInArrow(_elements, "id long, elements binary"))
    placed = left.join(largest, "bucket")
    outside = F.col("label") != F.col("largest")
    n_rows, n_all = F.ceil((F.col("all") - F.col("most")) / BLOCK), F.ceil(F.col("all") / BLOCK)
    block = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    first = placed.filter(outside).select("bucket", "id", "label", F.lit(0).alias("side"), block(n_rows).alias("i"), every(n_all).alias("j"))
    second = placed.select("bucket", "id", "label", F.lit(1).alias("side"), block(n_all).alias("j"), every(n_rows).alias("i")).select("bucket", "id", "label", "side", "i", "j")
    return scratch.write(first.unionByName(second).join(elements, "id").groupBy("bucket", "i", "j").applyInPandas(_compare, "a long, b long"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) for each row with an id: class_id is the least id of its class of near copies.

    Texts without words (null, empty, white space) are nobody's copy: a class
    of their own id.  A text of one to four words has one shingle, all of it.
    Rows without an id are left out.  Rows that share an id are one document
    and fall into one class.  Other columns are ignored.  An empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    split = rows.select("id", words(F.col("text")).alias("w"))
    hashed = split.select("id", F.md5(F.concat_ws(" ", "w")).alias("key"), _hashes(F.col("w")).alias("hashes"))
    signed = scratch.write(hashed.mapInArrow(_sign, "id long, key string, bands array<long>, short binary"))
    full = signed.filter(F.size("bands") > 0)
    reps = scratch.write(full.groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("short").alias("short")))
    members = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    shared = scratch.write(members.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last"))
    # only buckets of two texts or more go on
    members = scratch.write(members.join(shared.select("bucket", "lead").hint("merge"), "bucket").distinct())
    # the texts of all candidates, fetched once
    texts = scratch.write(rows.join(members.select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"]))
    links = _links(members.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")), reps, texts, scratch)
    labels = label(links, scratch)
    members = _unjoined(members, labels, scratch)
    first = Window.partitionBy("bucket").orderBy("id")
    leads = members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= LEADS).filter(F.col("n") > 1).select("bucket", F.col("id").alias("a"), F.col("label").alias("la"))
    pairs = leads.join(members, "bucket").filter((F.col("id") > F.col("a")) & (F.col("label") != F.col("la"))).select("a", F.col("id").alias("b"))
    links = scratch.write(links.unionByName(_links(pairs, reps, texts, scratch)))
    labels = label(links, scratch)
    left = _unjoined(members.select("bucket", "id"), labels, scratch)
    links = scratch.write(links.unionByName(_by_blocks(left, texts, scratch)))
    labels = label(links, scratch)
    grouped = signed.join(reps.select("key", "rep"), "key", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    named = grouped.join(labels, grouped["rep"] == labels["node"], "left").select("id", F.coalesce("label", "rep").alias("class_id"))
    return named.select(F.col("id").alias("doc_id"), "class_id")


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
