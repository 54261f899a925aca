"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasador.plans.lineage import cut_lineage, cut_measured


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the least node of its component.

    ``links`` has long columns ``a`` and ``b``. In each round a node takes the
    least label among its neighbours, and then the label of that label, so
    paths shorten by halves. Each round is a written table; only the number of
    changed labels reaches the driver. No links give no rows.
    """
    pairs = links.select("a", "b").where(F.col("a") != F.col("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both, "links")
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stepped.join(onward, "label").select("node", F.least("label", "next").alias("label"), "old")
        changed = F.count(F.when(F.col("label") != F.col("old"), 1))
        labels, found = cut_measured(jumped, "labels", changed=changed)
        labels = labels.drop("old")
        if not found["changed"]:
            return labels
