"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.sources.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node that it is connected with.

    Each round a node takes the least root among its own and its neighbours'
    (a partial aggregate, so a node of very many edges sends one row a task),
    and then the root of its root. Rounds end when no root changes; their
    number grows with the logarithm of a chain's length. Null ends are left
    out; loops are nodes of their own.
    """
    both = stored(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    links = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        far = links.join(now, links["a"] == now["node"]).select(F.col("b").alias("node"), "root")
        # a root that learns of a lesser one tells it to all that point to it, not to its neighbours alone
        told = far.join(now.select("node", F.col("root").alias("old")), "node").select(F.col("old").alias("node"), "root")
        least = far.unionByName(told).unionByName(now).groupBy("node").agg(F.min("root").alias("root"))
        up = least.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        new = stored(least.join(up, "root", "left").select("node", F.least("root", F.coalesce("upper", "root")).alias("root")))
        changed = new.join(now.select("node", F.col("root").alias("old")), "node").filter("root <> old").limit(1).count()
        now = new
        if not changed:
            return now
