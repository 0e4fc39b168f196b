"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) name; root is the least node of its component.

    Each step points the larger neighbours of a node, and then the smaller ones,
    at the least node around; the number of steps grows with the logarithm of
    the longest path. Every step is written out, so no plan grows and a lost
    executor costs one step.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        # Large star: neighbours above a node go to the least node around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("center"), F.least("a", "low").alias("low")
        )
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("center")).select(
            F.col("b").alias("a"), F.col("low").alias("b")
        ).distinct()
        # Small star: neighbours below a node, and it, go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "center")
        small = large.join(low, F.col("a") == F.col("center")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                              F.struct(F.col("a").alias("a"), F.col("low").alias("b")))).alias("e")
        ).select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct()
        edges = stored(small, "links")
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
