"""Connected components by joins: every node takes the smallest id it can see,
then jumps along the labels found so far, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import stored


def components(edges: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """``id, c`` for every node: c is the smallest id reachable by edges.

    Alternating large-star and small-star steps: each round links every
    neighbour larger than a node to the smallest id in its neighbourhood, so
    that hot nodes shed their edges, and rounds grow with the logarithm of the
    component's size.  Only nodes with edges take part; a round's edges are
    stored, so no lineage grows.  The driver sees one count per round."""
    e = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        parents = e.select(F.col("v").alias("u")).distinct()
        n, children = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == children and not e.join(parents, "u", "left_semi").count():
            break  # a forest of stars: every node has one parent, no parent is a child
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where("u <> v"), "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    top = e.groupBy("u").agg(F.min("v").alias("c"))
    kind = nodes.columns[0]
    return nodes.select(F.col(kind).alias("id")).join(top.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("c", "id").alias("c"))
