"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``links`` (a, b); component is the smallest node reachable.

    Alternates large and small stars: each pass hangs neighbours below smaller nodes until every node points to the smallest.
    A node's links are never gathered; only their minimum is. Links to null or to the node itself are passed over.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    )
    while True:
        # large star: larger neighbours hang below the smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself hang below the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(hung.filter("u <> v").distinct())
        # done when what the nodes point to points nowhere
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
