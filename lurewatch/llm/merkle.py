"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, groups (languages) have trees of arity 8 over their leaves
in order of id, and the groups' roots have such a tree of their own, whose root
names the dataset.

Nodes are labelled by (level, place).  A sweep visits them in ascending order
of label: a priority queue ordered by the parent's label delivers the digests of
children, and the digest made of them goes into the queue again.  A second sweep
in descending order delivers proof suffixes: a node hands each child
its own suffix, preceded by the child's siblings, until the leaves have theirs.

The queue is external in this sense: a sweep covers a block of 4,096
consecutive nodes, whose digests fit in memory whatever the data, and digests of block
roots are delivered through a written table, sorted into blocks again, until
each group has one node.  Blocks lie on whole subtrees, so only the block's root
leaves it.  Rounds are few: with 4,096 leaves a block, 10**11 leaves need four.

Places come from a range-partitioned sort: each partition numbers its runs and
a table with a row for each run adds what lies before, so a language with most
documents is spread like any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.llm.scratch import Scratch
from lurewatch.llm.sql import crc32_ctes

ARITY = 8
#: Levels that a block spans: it has ``ARITY ** LEVELS`` nodes at most.
LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Path of a node to a root: for each level, the place among the run's nodes and the siblings left to right.
Path = tuple[tuple[int, tuple[str, ...]], ...]


def digest(children: list[str] | tuple[str, ...]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def sweep(leaves: list[str], alone: bool, most: int = LEVELS) -> list[dict[int, str]]:
    """Digests by level and place.  ``alone``: these are all nodes, so the sweep ends when one remains; else a block's root is ``most`` levels up."""
    levels: list[dict[int, str]] = [dict(enumerate(leaves))]
    queue = [((1, i // ARITY), i, d) for i, d in enumerate(leaves)] if len(leaves) > 1 or not alone else []  # sorted, hence a heap
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        level, place = label
        if level == len(levels):
            levels.append({})
        levels[level][place] = made = digest(children)
        # the last node of its level is the root if nothing stands beside it
        more = bool(place) or bool(queue) if alone else level < most
        if more:
            heapq.heappush(queue, ((level + 1, place // ARITY), place, made))
    return levels


def deliver(levels: list[dict[int, str]], above: Path) -> list[Path]:
    """Paths of the leaves: suffixes go from each node to its children in descending order of label."""
    out: list[Path] = [above] * len(levels[0])
    queue = [(-(len(levels) - 1), 0, above)]
    while queue:
        level, place, suffix = heapq.heappop(queue)
        if level == 0:
            out[-place] = suffix
            continue
        below = levels[-level - 1]
        run = [below[i] for i in range(ARITY * -place, min(ARITY * (1 - place), len(below)))]
        for at in range(len(run)):
            heapq.heappush(queue, (level + 1, -(ARITY * -place + at), ((at, (*run[:at], *run[at + 1:])), *suffix)))
    return out


def fold(leaf: str, path: Path) -> str:
    """The root that a leaf and its siblings give."""
    for at, siblings in path:
        leaf = digest((*siblings[:at], leaf, *siblings[at:]))
    return leaf


def proof(path: Path) -> str:
    return digest([d for _, siblings in path for d in siblings])


def _show(path: Path) -> str:
    return "/".join(f"{at}:{''.join(siblings)}" for at, siblings in path)


def _read(path: str) -> Path:
    out = []
    for step in path.split("/") if path else ():
        at, _, siblings = step.partition(":")
        out.append((int(at), tuple(siblings[i:i + 64] for i in range(0, len(siblings), 64))))
    return tuple(out)


def leaf(columns: list[Column]) -> Column:
    """Hex digest of values: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (x.cast("string") for x in columns)]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` (with ``g``, not null) and ``i``: place within ``g`` by the ``order`` columns (nulls first)."""
    from pyspark import TaskContext
    shape = rows.schema.fields
    names = [f.name for f in shape]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, of, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for g in batch.column("g").to_pylist():
                if g != of:
                    of, n = g, 0
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*names, "part", "run"])

    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    numbered = scratch.write(ranged.mapInArrow(number, T.StructType([*shape, T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType())])))
    runs = numbered.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # runs with something before them: the first run of a partition at most, so never more rows than partitions
    later = scratch.write(runs.select(F.col("g").alias("_g"), F.col("part").alias("_part"), before.alias("before")).filter("before > 0"))
    joined = numbered.join(F.broadcast(later), (F.col("g") == F.col("_g")) & (F.col("part") == F.col("_part")), "left")
    return joined.select(*names, (F.col("run") + F.coalesce("before", F.lit(0))).alias("i"))


def _block(rows: DataFrame, levels: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("i") / F.lit(ARITY**levels)).cast("long"))


def _swept(part: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[dict[int, str]]]:
    part, size = part.sort_values("i"), ARITY**levels
    return part, sweep(part["digest"].tolist(), int(part["i"].iloc[0]) < size and len(part) < size, levels)


def forward(nodes: DataFrame, scratch: Scratch, levels: int) -> list[DataFrame]:
    """Rounds of (g, i, digest): the nodes, their blocks' roots, theirs, until each group has one."""
    def roots(part: pd.DataFrame) -> pd.DataFrame:
        part, made = _swept(part, levels)
        return pd.DataFrame({"g": [part["g"].iloc[0]], "i": [int(part["i"].iloc[0]) // ARITY**levels], "digest": [made[-1][0]]})

    rounds = [nodes.select("g", "i", "digest")]
    while rounds[-1].filter("i > 0").limit(1).count():
        rounds.append(scratch.write(_block(rounds[-1], levels).groupBy("g", "block").applyInPandas(roots, "g string, i long, digest string")))
    return rounds


def backward(rounds: list[DataFrame], scratch: Scratch, tops: DataFrame, levels: int) -> DataFrame:
    """(g, i, path, subroot, root) of the second round's nodes from ``tops`` (g, path, subroot, root): what the first round's blocks wait for."""
    def hand(part: pd.DataFrame, waiting: pd.DataFrame) -> pd.DataFrame:
        part, made = _swept(part, levels)
        top = waiting.iloc[0]
        paths = deliver(made, _read(top["path"]))
        return pd.DataFrame({"g": part["g"], "i": part["i"], "path": list(map(_show, paths)), "subroot": top["subroot"], "root": top["root"]})

    known = tops.withColumn("i", F.lit(0).cast("long"))
    for nodes in reversed(rounds[1:-1]):
        known = scratch.write(_block(nodes, levels).groupBy("g", "block").cogroup(known.groupBy("g", "i")).applyInPandas(hand, "g string, i long, path string, subroot string, root string"))
    return known


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, group, leaf, subroot, root, path, proof, folded, verified) of every row of ``docs``.

    A leaf is the digest of ``columns``.  ``path`` has the siblings level by
    level with the place among them, ``proof`` is their digest, ``folded`` the
    root recomputed from the leaf and ``verified`` whether it is the root.  With
    ``changed`` (column to expression) the fold starts from the leaf of the row
    as changed, so a row that the change alters isn't verified.

    Nulls are values of their own in leaves; a null group is a group, first in
    order, and null ids come first.  Rows with equal ids follow in order of
    their leaves, repeated rows are leaves each.  Texts may be empty or of any
    length: they are read once and only digests move.  Columns of other names
    are ignored.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    changed = changed or {}
    col = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit("")).alias("g"), col(id_col).alias("id"), leaf([col(c) for c in columns]).alias("digest"),
                       leaf([changed.get(c, col(c)) for c in columns]).alias("other"))
    leaves = scratch.write(placed(rows, ["id", "digest"], scratch))
    rounds = forward(leaves, scratch, levels)
    # the groups' roots are the leaves of the last tree
    subroots = scratch.write(placed(rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), ["group"], scratch))
    upper = forward(subroots, scratch, levels)
    no_path = upper[-1].select("g", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    waits = backward(upper, scratch, no_path, levels)

    def tops(part: pd.DataFrame, waiting: pd.DataFrame) -> pd.DataFrame:
        part, made = _swept(part, levels)
        top = waiting.iloc[0]
        paths = deliver(made, _read(top["path"]))
        return pd.DataFrame({"g": part["group"], "path": list(map(_show, paths)), "subroot": part["digest"], "root": top["root"]})

    known = scratch.write(_block(subroots, levels).groupBy("g", "block").cogroup(waits.groupBy("g", "i")).applyInPandas(tops, "g string, path string, subroot string, root string"))
    known = backward(rounds, scratch, known, levels)

    def prove(part: pd.DataFrame, waiting: pd.DataFrame) -> pd.DataFrame:
        part, made = _swept(part, levels)
        top = waiting.iloc[0]
        paths = deliver(made, _read(top["path"]))
        folded = [fold(d, p) for d, p in zip(part["other"], paths)]
        return pd.DataFrame({"id": part["id"], "group": part["g"], "leaf": part["digest"], "subroot": top["subroot"], "root": top["root"], "path": list(map(_show, paths)),
                             "proof": list(map(proof, paths)), "folded": folded, "verified": [f == top["root"] for f in folded]})

    kind = leaves.schema["id"].dataType.simpleString()
    proven = _block(leaves, levels).groupBy("g", "block").cogroup(known.groupBy("g", "i")).applyInPandas(
        prove, f"id {kind}, group string, leaf string, subroot string, root string, path string, proof string, folded string, verified boolean")
    name = F.when(F.col("group") != "", F.substring("group", 2, 1 << 30))
    return proven.select(F.col("id").alias("doc_id"), name.alias("group"), "leaf", "subroot", "root", "path", "proof", "folded", "verified")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Proofs of all ``documents``; every third one, by hash of its id, is folded with A-Z of its text lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    tampered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    found = manifest(docs, COLUMNS, changed={"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def _oracle(levels: int = 9) -> str:
    """Levels unrolled; a group's nodes stop at the level where one remains."""
    value = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf_of = lambda text: f"sha256({' || '.join(value(c) for c in COLUMNS[:-1])} || {value(text)})"

    def tree(name: str, source: str) -> str:
        """name_l: (g, i, h) of the nodes of each level, as long as more than one was below."""
        out = f"{name}_0 AS ({source}),\n"
        for k in range(1, levels + 1):
            out += f"""{name}_{k} AS (SELECT g, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}_{k - 1}
  WHERE g IN (SELECT g FROM {name}_{k - 1} WHERE i > 0) GROUP BY g, i // 8),\n"""
        parts = " UNION ALL ".join(f"SELECT {k} AS k, g, i, h FROM {name}_{k}" for k in range(levels + 1))
        return out + f"""{name}_all AS ({parts}),
{name}_top AS (SELECT g, max(k) AS k, arg_max(h, k) AS h FROM {name}_all GROUP BY g)"""

    def paths(name: str, rows: str) -> str:
        """name_paths: siblings of each leaf (left and right) by level below the top."""
        return f"""{name}_paths AS (
  SELECT l.g, l.i, a.k, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i < l.i // CAST(8 ** a.k AS BIGINT)), '') AS lefts, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i > l.i // CAST(8 ** a.k AS BIGINT)), '') AS rights
  FROM {rows} l JOIN {name}_top t USING (g) JOIN range({levels}) AS a(k) ON a.k < t.k
  JOIN {name}_all s ON s.k = a.k AND s.g = l.g AND s.i // 8 = l.i // CAST(8 ** (a.k + 1) AS BIGINT)
  GROUP BY ALL
)"""

    def folds(name: str, start: str) -> str:
        out = f"{name}_f0 AS ({start}),\n"
        path = name.removesuffix("_again")
        for k in range(levels):
            out += f"{name}_f{k + 1} AS (SELECT f.*  REPLACE (CASE WHEN p.k IS NULL THEN f.h ELSE sha256(p.lefts || f.h || p.rights) END AS h) FROM {name}_f{k} f LEFT JOIN {path}_paths p ON p.g = f.g AND p.i = f.i AND p.k = {k}),\n"
        return out.rstrip(",\n")

    return f"""
WITH {crc32_ctes("documents", "coalesce(CAST(doc_id AS VARCHAR), '')", doublings=9)},
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf_of("text")} AS leaf,
         {leaf_of("CASE WHEN crc32 % 3 = 0 THEN translate(text, '" + UPPER + "', '" + LOWER + "') ELSE text END")} AS other
  FROM documents JOIN crc ON s = coalesce(CAST(doc_id AS VARCHAR), '')
), o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
),
{tree("t", "SELECT g, i, leaf AS h FROM o")},
{paths("t", "o")},
{tree("u", "SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM t_top")},
u_rows AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, g AS lang FROM t_top),
{paths("u", "u_rows")},
{folds("t", "SELECT o.g, o.i, o.doc_id, o.leaf, o.other AS h FROM o")},
{folds("u", f"SELECT u_rows.g, u_rows.i, x.doc_id, x.leaf, x.h, x.g AS lang, x.i AS place FROM t_f{levels} x JOIN u_rows ON u_rows.lang = x.g")},
proofs AS (
  SELECT lang, place, sha256(coalesce(string_agg(sibs, '' ORDER BY lv), '')) AS proof_sha256 FROM (
    SELECT o.g AS lang, o.i AS place, NULL AS sibs, -1 AS lv FROM o
    UNION ALL SELECT p.g, p.i, p.lefts || p.rights, p.k FROM t_paths p
    UNION ALL SELECT o.g, o.i, p.lefts || p.rights, 100 + p.k FROM o JOIN u_rows r ON r.lang = o.g JOIN u_paths p ON p.i = r.i
  ) GROUP BY lang, place
)
SELECT f.doc_id, f.leaf, t_top.h AS subroot, u_top.h AS root, proof_sha256, f.h AS folded_root, f.h = u_top.h AS verified
FROM u_f{levels} f JOIN t_top ON t_top.g = f.lang JOIN u_top ON true JOIN proofs ON proofs.lang = f.lang AND proofs.place = f.place
"""


ORACLE_SQL = _oracle()
