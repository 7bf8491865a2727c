"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.skew import lookup_join
from chronoweave.session import cut_lineage


def connected(edges: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``node, component`` of every node of edges ``a, b``; a component is named by its least node, of any type that has an order.

    Each round a node takes the least label around it and then that label's own, so ways are halved every time and rounds follow
    the logarithm of a component's width. Labels are combined before each shuffle, and nodes that look up one hub are spread.
    """
    both = edges.select("a", "b").filter("a is not null and b is not null")
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        around = lookup_join(both.withColumnRenamed("b", "node"), labels, ["node"], hot_rows=hot_rows).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        above = nearer.select(F.col("node").alias("label"), F.col("label").alias("_above"))
        jumped = cut_lineage(lookup_join(nearer, above, ["label"], hot_rows=hot_rows).select("node", "_old", F.least("label", "_above").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.filter("label <> _old").isEmpty():
            return labels.withColumnRenamed("label", "component")
