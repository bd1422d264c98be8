"""Connected components of a link table that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b; longs); the component is its smallest node.

    Each round takes the smallest label among a node's neighbours, with map-side minima, then jumps to that label's own
    label, so rounds grow with the logarithm of a chain's length. Labels are written each round; hot nodes are only on
    the larger side of plain joins, which the engine splits. An empty table gives an empty result.
    """
    both = save(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        nearer = save(nearer, "nearer")
        of = nearer.select(F.col("node").alias("at"), F.col("new").alias("its"))
        jumped = save(nearer.join(of, nearer["new"] == of["at"], "left").select("node", "old", F.least("new", "its").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label < old").head(1):
            return labels.withColumnRenamed("label", "component")
