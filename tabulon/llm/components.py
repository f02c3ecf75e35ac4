"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import brief_shuffles, discard, staged


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``links`` (longs ``a`` and ``b``), as a staged table.

    Alternating large-star and small-star steps: every node points its larger (then its smaller) neighbours to
    the smallest one, until nothing changes. Links never grow in number, and each step is written to the shared folder, where
    it replaces the one before. A node with very many links is only a key of a partial minimum and of a join that Spark can split.
    """
    order = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    with brief_shuffles(links.sparkSession):
        edges = staged(order.distinct(), "links")
        before = None
        while True:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            # Large star: neighbours above a node are linked to the smallest around it.
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # Small star: neighbours below a node, and the node itself, are linked to the smallest of them.
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
            last, edges = edges, staged(small.where("a <> b").distinct(), "links")
            discard(last)
            stars = edges.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.hash("b")).alias("h"))
            now = stars.agg(F.count("*"), F.max("n"), F.sum(F.xxhash64("a", "n", "h").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        found = staged(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
        discard(edges)
    return found
