"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilake.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node that
    is reachable. Each round takes the smallest label of the neighbours and then
    the label of that label; rounds grow with the logarithm of the longest path
    of a chain in order. Only sums reach the driver. No links: no rows.
    """
    both = staged(
        links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(),
        "links",
    )
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        )
        better = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = staged(
            better.join(jump, "label").select("node", "before", F.least("label", "next").alias("label")), "labels"
        )
        labels = step.select("node", "label")
        if step.where("label <> before").isEmpty():
            return labels
