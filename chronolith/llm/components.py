"""Connected components of an edge list, distributed: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node with an edge; root is the smallest node of its component.

    Every round takes the smallest label among a node and its neighbours, then the label of that label, so paths shorten
    by half at least. Each round is written to the shared folder; it ends when no label changes. Loops and repeated edges
    do no harm; no edge gives no row.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
    both = written(both.where("node <> other").distinct(), "component-edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")), "component-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = written(hop.join(up, "root", "left").select("node", "old", F.coalesce("up", "root").alias("root")), "component-labels")
        labels = jumped.select("node", "root")
        if jumped.where("old <> root").isEmpty():
            return labels
