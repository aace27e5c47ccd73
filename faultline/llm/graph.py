"""Connected components over tables of links; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import attach, held


def _ordered(links: DataFrame) -> DataFrame:
    return (
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link (a, b); the root is the smallest node it can reach.

    Each round hangs every neighbour of a node below the smallest node around it, until all
    are stars. Rounds grow with the logarithm of the longest path. A node with many
    links is split by ``attach``.
    """
    edges = held(_ordered(links), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = held(
            both.groupBy("a").agg(
                F.count(F.lit(1)).alias("group_size"), F.least(F.min("b"), F.col("a")).alias("low")
            ),
            "least",
        )
        hung = attach(both, least, "a", "b", ["low"])
        pulled = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
        following = held(_ordered(pulled), "links")
        # Stars: every upper end has one link, and no lower end hangs below another node.
        loose = following.groupBy("a").count().filter("count > 1").limit(1).count()
        if not loose:
            heads = following.select("b").distinct()
            loose = heads.join(following.select("a"), F.col("a") == F.col("b"), "left_semi").limit(1).count()
        edges = following
        if not loose:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return held(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "components")
