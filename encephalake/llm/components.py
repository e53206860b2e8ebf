"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the component's smallest node.

    Each round points a node's larger neighbours at its smallest one, then its smaller ones;
    the rounds end when every link leads from a node to a root, after a logarithmic number in
    practice. A round is written to the shared folder, so lineage stays short; the driver sees
    one row of a round at most.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = written(links.where(F.col("a") != F.col("b")).select(a, b).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        lowest = written(lowest, "lowest")
        large = both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "links")
        if _are_stars(edges):
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one link, to a node that has none of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()
