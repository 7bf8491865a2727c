"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import written
from chronoweave.operators.skew import BROADCAST_ROWS, salted_join


class Union:
    """Sets of anything that can be ordered, named by their smallest member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components of some edges as stars: rows (node, smallest node of its component)."""
    own = Union()
    for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
        own.join(x, y)
    found = [(x, own.root(x)) for x in own.up]
    return np.array([(x, y) for x, y in found if x != y], np.int64).reshape(-1, 2)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b).

    A large star hangs a node's larger neighbours under its smallest neighbour and a small star its smaller ones;
    minima are combined before each shuffle and a hub's rows meet one row (sent to all tasks where minima are few, else to
    several), so no group of neighbours is gathered. Every round is written; rounds end when each node has one parent and no parent has one.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    # no round has more minima than nodes, and each edge has two
    few = 2 * now.count() <= BROADCAST_ROWS

    def met(many: DataFrame, minima: DataFrame) -> DataFrame:
        return many.join(F.broadcast(minima), "u") if few else salted_join(many, minima, ["u"])

    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = met(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (met(large, smallest).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(smallest.select("u", F.col("m").alias("v"))))
        now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        nodes = now.select("u").unionByName(now.select(F.col("v").alias("u")).distinct())
        if nodes.groupBy("u").count().filter("count > 1").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
