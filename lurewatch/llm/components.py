"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.scratch import Scratch


def label(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for each node of (a, b): the least node of its component.

    A round gives each node the least label among its neighbours' and then the
    label of its label, so the rounds grow with the logarithm of a component's
    width.  Every round is written to the shared folder.  Hubs are safe: minima
    combine before the shuffle, and the joins split large partitions.
    """
    both = scratch.write(links.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("x")).select("x.*").distinct())
    labels = scratch.write(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        lower = scratch.write(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before")))
        of_label = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        jumped = scratch.write(lower.join(of_label, "label").select("node", F.least("label", "jump").alias("label"), "before"))
        scratch.drop(labels, lower)
        if not jumped.filter("label <> before").limit(1).count():
            scratch.drop(both)
            return jumped.select("node", "label")
        labels = jumped
