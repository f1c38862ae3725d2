"""Sharding by a hierarchical weighted hash tree.  DataFrame operations only.

The tree has regions, racks and shards (any depth will do); a node weighs what
the shards below it weigh.  A document descends from the root: every child of
the node it has reached draws ``-ln(u) / weight``, with ``u`` from the hash of
the child's path and the document's key, and the least draw wins.  So a node
gets documents in proportion to its weight, no state is kept, and a change of a
weight moves documents only between the changed child and its siblings: no
document moves inside a subtree, or between subtrees, whose weights stay.

``grown`` adds a shard as a subtree of its own (new hardware is a failure
domain of its own), hence documents move into the new shard only.

Slots number the documents of a shard without gaps.  Equal rows are counted
before the shuffle, the rest is dealt into buckets of a hash, and a slot is the
sum over the buckets before plus the sum inside the bucket: no task holds a
shard, and a key with a third of all rows is one counted row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.scratch import Scratch
from lurewatch.llm.sql import crc32_ctes

#: Region -> rack -> shard -> weight: 16 shards of equal weight.
Tree = dict
TREE: Tree = {f"region{a}": {f"rack{b}": {8 * a + 4 * b + c: 1.0 for c in range(4)} for b in range(2)} for a in range(2)}
#: Counted rows that a bucket of slots aims at, and rows that one counted row expands to at a time.
BUCKET_ROWS, CHUNK = 20_000, 10_000
#: Draws have 48 bits.
BITS = float(2**48)


def weight(node: Tree | float) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def height(tree: Tree | float) -> int:
    return 1 + max(map(height, tree.values())) if isinstance(tree, dict) and tree else 0


def grown(tree: Tree, shard: int, shard_weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, below a new region and a new rack."""
    node: Tree | float = {shard: shard_weight}
    for level in range(height(tree) - 2, -1, -1):
        node = {f"level{level}-of-{shard}": node}
    return {**tree, **node}


def _inner(tree: Tree, path: str = "") -> dict[str, list[tuple[str, float, int]]]:
    """Children with a weight of every inner node by its path: (path, weight, shard or -1)."""
    out = {path: [(f"{path}/{name}", weight(node), -1 if isinstance(node, dict) else int(name)) for name, node in tree.items() if weight(node) > 0]}
    for name, node in tree.items():
        if isinstance(node, dict):
            out |= _inner(node, f"{path}/{name}")
    return out


def _hash(text: Column) -> Column:
    """48 bits of the text's md5, as a double."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")


def descend(key: Column, tree: Tree, seed: str = "shard-1") -> Column:
    """The shard (int) of a key; a null key counts as ``-``, a tree without weight gives null."""
    nodes = {path: children for path, children in _inner(tree).items() if children}
    table = F.create_map(*[x for path, children in nodes.items() for x in (
        F.lit(path), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(s).alias("shard")) for p, w, s in children]))]) if nodes else None
    name = F.coalesce(key.cast("string"), F.lit("-"))

    def draw(child: Column) -> Column:
        u = (_hash(F.concat(F.lit(seed), child["path"], F.lit(":"), name)) + F.lit(0.5)) / F.lit(BITS)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["path"].alias("path"), child["shard"].alias("shard"))

    if table is None:
        return F.lit(None).cast("int")
    at = F.struct(F.lit("").alias("path"), F.lit(-1).alias("shard"))
    for _ in range(height(tree)):
        # one step: the children of where the key is draw; a key that has come to a shard stays there
        at = F.element_at(F.transform(F.array(at), lambda x: F.when(x["shard"] >= 0, x).otherwise(
            F.element_at(F.transform(F.array(F.array_min(F.transform(F.try_element_at(table, x["path"]), draw))), lambda y: F.struct(y["path"].alias("path"), y["shard"].alias("shard"))), 1))), 1)
    return at["shard"].cast("int")


def assign(docs: DataFrame, tree: Tree, next_tree: Tree | None = None, key_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``shard``, and ``grown_shard`` by ``next_tree`` (null without one).

    The key alone decides: equal keys share a shard, rows with a null key share
    one as well.  A projection; nothing is shuffled, texts of any length pass
    through.  Columns named ``shard`` and ``grown_shard`` give way, all others
    stay.  An empty table gives no rows.
    """
    key = F.col(f"`{key_col}`")
    after = descend(key, next_tree) if next_tree else F.lit(None).cast("int")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "grown_shard")], descend(key, tree).alias("shard"), after.alias("grown_shard"))


def slots(rows: DataFrame, order: list[str], shard_col: str = "shard") -> DataFrame:
    """All rows and columns with ``slot`` (long): 0, 1, ... within each shard, by a hash of the ``order`` columns and then these.

    Rows equal in all columns are interchangeable: they are counted, numbered
    together and written out again.  Nulls in ``order`` are values of their own, first.  A
    column named ``slot`` gives way.  An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "slots")
    names = [c for c in rows.columns if c != "slot"]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    text = F.concat_ws(":", F.lit("slot"), *[F.coalesce(F.col("row")[c].cast("string"), F.lit("-")) for c in order])
    counted = scratch.write(rows.select(row.alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n")).withColumn("hash", _hash(text)))
    buckets = max(1, -(-counted.count() // BUCKET_ROWS))
    dealt = counted.select("row", "n", "hash", F.col("row")[shard_col].alias("shard"), F.floor(F.col("hash") * F.lit(buckets) / F.lit(BITS)).alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("shard", "bucket").agg(F.sum("n").alias("sum")).select("shard", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("hash", *[F.col("row")[c] for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals.hint("merge"), ["shard", "bucket"])
    # a counted row leaves in chunks, which are dealt anew: a hot one is not one task's work
    chunks = placed.select("row", (F.col("base") + F.col("first")).alias("first"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("at")).hint("rebalance")
    upto = F.least(F.col("n"), F.col("at") + CHUNK) - 1
    each = chunks.select("row", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + upto)).alias("slot"))
    return each.select(*[F.col("row")[c].alias(c) for c in names], "slot")


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 15 by law ``key``, and the shard of each with one shard more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return slots(assign(rows, TREE, grown(TREE, 16)), ["doc_id", "text_crc32", "size"])


def _oracle() -> str:
    """The draws of each level as ordered subqueries over the tree as a table."""
    def values(tree: Tree) -> str:
        return ", ".join(f"('{parent}', '{p}', {w!r}::DOUBLE, {s})" for parent, children in _inner(tree).items() for p, w, s in children)

    def steps(name: str, tree: Tree) -> str:
        out, last = f"{name}_tree(parent, path, weight, shard) AS (VALUES {values(tree)}),\n", "keys"
        for level in range(height(tree)):
            path = "''" if level == 0 else "p.path"
            out += f"""{name}_{level} AS (SELECT p.name, arg_min(t.path, -ln((CAST(CAST('0x' || md5('shard-1' || t.path || ':' || p.name)[1:12] AS BIGINT) AS DOUBLE) + 0.5) / {BITS}) / t.weight) AS path
  FROM {last} p JOIN {name}_tree t ON t.parent = {path} GROUP BY p.name),\n"""
            last = f"{name}_{level}"
        return out + f"{name} AS (SELECT p.name, t.shard FROM {last} p JOIN {name}_tree t ON t.path = p.path)"

    return f"""
WITH {crc32_ctes("documents", "coalesce(text, '')")}, d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '-') AS name, octet_length(encode(coalesce(text, ''))) + 1 AS size, crc32 AS text_crc32
  FROM documents JOIN crc ON s = coalesce(text, '')
), keys AS (SELECT DISTINCT name FROM d),
{steps("now", TREE)},
{steps("later", grown(TREE, 16))}
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(now.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY now.shard ORDER BY CAST('0x' || md5('slot:' || name || ':' || text_crc32 || ':' || size)[1:12] AS BIGINT), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(later.shard AS INTEGER) AS grown_shard
FROM d JOIN now USING (name) JOIN later USING (name)
"""


ORACLE_SQL = _oracle()
