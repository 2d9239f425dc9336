"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpoint


def _around(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) -> (node, root): root is the smallest node in reach.

    Every node on a link gets one row; loops and repeated links do no harm,
    no links give no rows. Large-star and small-star steps (Kiveris et al.,
    "Connected Components in MapReduce and Beyond") keep the table linear in
    the links. The least neighbour comes from an aggregate that combines
    before its shuffle, and is joined back, which Spark can split where one
    node has many links. Each step is cut by a checkpoint in the shared folder.
    """
    edges = checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                            .where("u <> v").distinct())
    state = None
    while True:
        # large star: larger neighbours move to the least neighbour (or the node itself)
        both = _around(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct())
        large = checkpoint(large)
        # small star: the node and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = checkpoint(small)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            break
        state = new
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
                 .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
