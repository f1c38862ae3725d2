"""Line deduplication by a deletion-neighbourhood join.  DataFrame operations only.

Every line with a word is dropped if the corpus has an earlier occurrence of it.
A line of at least ``LEAST_WORDS`` words is also dropped if it is one word
(replaced, inserted or left out) away from an earlier line that is kept: a
similarity of 0.8 or more.  Earlier means a smaller document id, then a smaller
place.  What a dropped line resembles stays, so no text is lost without a kept neighbour.

1. Equal lines: the earliest occurrence of each pair of 64-bit hashes.
2. Candidates: one edit leaves a line's beginning or its end as it was, so only
   lines that share a hash of either with another line go on.
3. Deletion neighbourhood: a candidate emits the hashes of all its variants
   with one word left out.  Lines with an equal variant at the same place
   differ by a replaced word, and a line equal to another's variant lacks a
   word of it.  Lines of one hash are a group and never become pairs: its
   earliest line (minima combine before the shuffle) stands for it.
4. The edit distance of a line to that earliest one is verified word by word.
   A line without such a neighbour is kept, one whose neighbour is kept goes.
   For the few others, whose neighbours went themselves, the groups' earliest
   lines that haven't gone are looked up again, until all are settled.

Joins sort and merge at every size, so that the work on small tables foretells large ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.scratch import Scratch

LEAST_WORDS = 5
#: The characters between words, and a sign of a word.
SPACE, NOT_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _words(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda w: w != "")


def _lines(docs: DataFrame) -> DataFrame:
    """(id, line_no, w) of the lines with a word; told by the text, so that the words are made once."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(NOT_SPACE)).select("id", "line_no", _words(F.col("line")).alias("w"))


def _ends(w: Column) -> Column:
    """(key, side, width) of the line's first and last words, as many as the largest power of two up to half its length.

    Lines at a step of that number emit both sizes, so lines whose lengths
    differ by one meet.  Lines that are too short for near matches have none.
    """
    n = F.size(w)
    size = lambda k: F.pow(F.lit(2.0), F.floor(F.log2(k / 2))).cast("int")

    def both(s: Column) -> Column:
        def end(side: str, from_: Column) -> Column:
            return F.struct(F.xxhash64(F.lit(side), s, F.slice(w, from_, s)).alias("key"), F.lit(side).alias("side"), s.alias("width"))
        return F.array(end("begin", F.lit(1)), end("end", n - s + 1))

    ends = F.flatten(F.transform(F.array_distinct(F.array(size(n - 1), size(n + 1))), both))
    return F.when(n >= LEAST_WORDS, ends).otherwise(F.array().cast("array<struct<key:bigint,side:string,width:int>>"))


def _variants(w: Column, begin: Column, end: Column, uneven: Column) -> Column:
    """(key, role) of a line: its variants with one word left out, by place and without it; and the line itself.

    A shared beginning of ``begin`` words puts the edit after it, a shared end
    of ``end`` words before it, so only those places are left out.  Variants
    without their place matter only to lines of unlike length (``uneven``).
    """
    n = F.size(w)
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(i >= begin, F.lit(False)) | F.coalesce(i < n - end, F.lit(False)))
    left_out = F.transform(places, lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice(w, F.lit(1), i), F.slice(w, i + 2, n)).alias("v")))

    def roles(x: Column) -> Column:
        replaced = F.transform(x, lambda y: F.struct(F.xxhash64(F.lit("at"), n, y["i"], y["v"]).alias("key"), F.lit(0).alias("role")))
        shorter = F.transform(F.array_distinct(F.transform(x, lambda y: y["v"])), lambda v: F.struct(F.xxhash64(F.lit("of"), v).alias("key"), F.lit(1).alias("role")))
        whole = F.array(F.struct(F.xxhash64(F.lit("of"), F.xxhash64(w)).alias("key"), F.lit(2).alias("role")))
        return F.when(uneven, F.concat(replaced, shorter, whole)).otherwise(replaced)

    return F.flatten(F.transform(F.array(left_out), roles))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two lines of words differ by exactly one replaced, inserted or missing word."""
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) == 1

    def lacks(long: Column, short: Column) -> Column:
        # words before the first difference, then the rest must agree past the extra word
        same = F.aggregate(F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: x == y), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                           lambda s, e: F.struct(F.when(s["on"] & e, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
        return F.slice(long, same + 2, F.size(long)) == F.slice(short, same + 1, F.size(long))

    return F.when(F.size(a) == F.size(b), replaced).when(F.size(a) == F.size(b) + 1, lacks(a, b)).when(F.size(b) == F.size(a) + 1, lacks(b, a)).otherwise(F.lit(False))


def _settle(groups: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(r) of the lines that go: those one word away from an earlier line that is kept.

    ``groups`` has (key, role, r), r in order of place.  Of a replaced word
    (role 0) the partners are the same group, of a missing one (1) the lines that
    are what is left (2), and the other way round.
    """
    partner = F.when(F.col("role") == 0, 0).otherwise(3 - F.col("role"))
    words = lambda name: lines.select(F.col("r").alias(name), F.col("w").alias(f"w_{name}")).hint("merge")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(words("r"), "r").join(words("before"), "before")
        return both.filter(_one_edit(F.col("w_r"), F.col("w_before"))).select("r", "before")

    def earliest(members: DataFrame) -> DataFrame:
        return members.groupBy("key", F.col("role").alias("of")).agg(F.min("r").alias("before")).hint("merge")

    looking = groups.withColumn("of", partner)
    pairs = scratch.write(verified(looking.join(earliest(groups), ["key", "of"]).filter("before < r").select("r", "before")))
    having = pairs.select("r").distinct()
    # those whose neighbour has none itself go
    gone = scratch.write(pairs.join(having.select(F.col("r").alias("before")).hint("merge"), "before", "left_anti").select("r").distinct())
    open_ = scratch.write(having.join(gone.hint("merge"), "r", "left_anti"))
    while open_.limit(1).count():
        touched = looking.join(open_.hint("merge"), "r", "left_semi").select("key").distinct()
        here = looking.join(touched.hint("merge"), "key", "left_semi").join(gone.hint("merge"), "r", "left_anti")
        here = scratch.write(here.join(open_.withColumn("open", F.lit(True)).hint("merge"), "r", "left").select("key", "role", "of", "r", F.coalesce("open", F.lit(False)).alias("open")))
        asking = here.filter("open")
        near_kept = verified(asking.join(earliest(here.filter("not open")), ["key", "of"]).filter("before < r").select("r", "before")).select("r").distinct()
        near_kept = scratch.write(near_kept)
        waiting = asking.join(earliest(asking), ["key", "of"]).filter("before < r").select("r").distinct()
        gone = scratch.write(gone.unionByName(near_kept))
        open_ = scratch.write(waiting.join(near_kept.hint("merge"), "r", "left_anti"))
    return gone


def _near(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2) of the distinct lines that are one word away from an earlier one that is kept."""
    keys = distinct.select(F.explode("ends").alias("end"), "h1", "n").select("end.*", "h1", "n")
    shared = scratch.write(keys.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), (F.min("n") < F.max("n")).alias("uneven")).filter("x <> y").select("key", "uneven"))
    wanted = keys.join(shared.hint("merge"), "key").groupBy("h1").agg(
        F.min(F.when(F.col("side") == "begin", F.col("width"))).alias("begin"), F.min(F.when(F.col("side") == "end", F.col("width"))).alias("end"), F.max("uneven").alias("uneven"))
    places = scratch.write(distinct.join(wanted.hint("merge"), "h1").select("first.id", F.struct("first.line_no", "begin", "end", "uneven").alias("place")))
    by_doc = places.groupBy("id").agg(F.collect_list("place").alias("places"))
    # the words of the candidates, from the documents that hold them, numbered in order of place
    lines = docs.join(by_doc.hint("merge"), "id").select("id", F.split("text", "\n").alias("lines"), F.explode("places").alias("p")).select(
        "id", "p.line_no", _words(F.get("lines", F.col("p.line_no"))).alias("w"), "p.begin", "p.end", "p.uneven").dropDuplicates(["id", "line_no"])
    lines = scratch.write(lines.sort("id", "line_no").withColumn("r", F.monotonically_increasing_id()))
    scratch.drop(shared, places)
    emitted = scratch.write(lines.select("r", F.explode(_variants(F.col("w"), F.col("begin"), F.col("end"), F.col("uneven"))).alias("v")).select("r", "v.key", "v.role"))
    several = emitted.groupBy("key").agg(F.min("r").alias("x"), F.max("r").alias("y")).filter("x < y").select("key")
    groups = scratch.write(emitted.join(several.hint("merge"), "key", "left_semi").distinct())
    scratch.drop(emitted)
    gone = _settle(groups, lines, scratch)
    found = scratch.write(lines.join(gone.hint("merge"), "r", "left_semi").select(F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2")).distinct())
    scratch.drop(groups, lines)
    return found


def drops(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, drops): the places of the lines to drop, for the documents that have any."""
    w = F.col("w")
    seen = scratch.write(_lines(docs).select("id", "line_no", F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(1), w).alias("h2"), F.size(w).alias("n"), _ends(w).alias("ends")))
    distinct = scratch.write(seen.groupBy("h1", "h2").agg(F.min(F.struct("id", "line_no")).alias("first"), F.max(F.struct("id", "line_no")).alias("last"), F.first("n").alias("n"), F.first("ends").alias("ends")))
    near = _near(docs, distinct, scratch)
    repeated = distinct.filter(F.col("first") < F.col("last")).select("h1", "h2", "first")
    # lines to judge: those that repeat, and those near an earlier one (these lose their first occurrence as well)
    judged = repeated.unionByName(near.withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType)))
    judged = scratch.write(judged.groupBy("h1", "h2").agg(F.max(F.col("first").isNull()).alias("near"), F.max("first.id").alias("first_id"), F.max("first.line_no").alias("first_no")))
    first = (F.col("id") == F.col("first_id")) & (F.col("line_no") == F.col("first_no"))
    gone = seen.select("id", "line_no", "h1", "h2").join(judged.hint("merge"), ["h1", "h2"]).filter(F.col("near") | ~first)
    found = scratch.write(gone.groupBy("id").agg(F.collect_set("line_no").alias("drops")))
    scratch.drop(seen, distinct, near, judged)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without dropped lines, and ``n_dropped`` (long).

    Null texts stay null and empty ones empty.  Rows without an id keep their
    text and count for nobody.  Rows that share an id are one document: equal
    places in them are the same line.  A text may become empty.  Columns named
    ``n_dropped`` give way to the result; all others stay.  An empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    found = drops(docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), scratch)
    joined = docs.alias("d").join(found.hint("merge").alias("f"), F.col(f"d.{id_col}") == F.col("f.id"), "left")
    lines = F.split(F.col(f"d.{text_col}"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("f.drops"))
    kept = F.element_at(F.transform(F.array(lines), lambda all: F.array_join(F.transform(left, lambda i: F.get(all, i)), "\n")), 1)
    text = F.when(F.col("f.drops").isNull(), F.col(f"d.{text_col}")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns if c != "n_dropped"],
                         F.coalesce(F.size("f.drops"), F.lit(0)).cast("long").alias("n_dropped"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its dropped lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


def _oracle(rounds: int = 12) -> str:
    """Variants here are the words themselves, with the left-out place marked; no hashes and no candidates.  Neighbours settle in rounds."""
    out = ""
    for k in range(rounds):
        out += f"""
k{k + 1} AS MATERIALIZED (
  SELECT s, first, CASE WHEN state <> 'open' THEN state WHEN near_kept THEN 'gone' WHEN NOT near_open THEN 'kept' ELSE 'open' END AS state
  FROM (SELECT a.s, a.first, any_value(a.state) AS state, coalesce(bool_or(b.state = 'kept'), false) AS near_kept, coalesce(bool_or(b.state = 'open'), false) AS near_open
        FROM k{k} a LEFT JOIN e ON e.s = a.s LEFT JOIN k{k} b ON b.s = e.t GROUP BY a.s, a.first)
),"""
    return rf"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), o AS (
  SELECT doc_id, i - 1 AS line_no, list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM l, unnest(generate_series(1, len(ls))) AS g(i)
  WHERE doc_id IS NOT NULL AND text IS NOT NULL
), q AS (
  SELECT doc_id, line_no, array_to_string(w, ' ') AS s, w, {{'d': doc_id, 'n': line_no}} AS pos FROM o WHERE len(w) >= 1
), u AS (
  SELECT s, min(pos) AS first, any_value(w) AS w FROM q GROUP BY s
), long AS (
  SELECT * FROM u WHERE len(w) >= {LEAST_WORDS}
), v AS MATERIALIZED (
  SELECT s, first, 'at ' || i || ':' || array_to_string(list_concat(w[1:i-1], ['?'], w[i+1:]), ' ') AS key, 0 AS role
  FROM long, unnest(generate_series(1, len(w))) AS g(i)
  UNION
  SELECT s, first, 'of ' || array_to_string(list_concat(w[1:i-1], w[i+1:]), ' '), 1
  FROM long, unnest(generate_series(1, len(w))) AS g(i)
  UNION
  SELECT s, first, 'of ' || s, 2 FROM long
), e AS MATERIALIZED (
  -- each line with its earlier neighbours
  SELECT DISTINCT a.s, b.s AS t FROM v a JOIN v b ON a.key = b.key AND b.first < a.first AND (a.role + b.role = 0 OR a.role + b.role = 3)
), k0 AS MATERIALIZED (
  SELECT s, first, CASE WHEN s IN (SELECT s FROM e) THEN 'open' ELSE 'kept' END AS state FROM long
),{out}
gone AS (
  SELECT q.doc_id, list(DISTINCT q.line_no) AS drops
  FROM q JOIN u USING (s) LEFT JOIN k{rounds} k ON k.s = q.s
  WHERE k.state = 'gone' OR q.pos <> u.first GROUP BY q.doc_id
)
SELECT d.doc_id,
       CASE WHEN g.drops IS NULL THEN d.text ELSE
         array_to_string(list_transform(list_filter(generate_series(1, len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(g.drops, i - 1)),
                                        lambda i: string_split(d.text, chr(10))[i]), chr(10)) END AS text,
       CAST(coalesce(len(g.drops), 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""


ORACLE_SQL = _oracle()
